"""Registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webfrontier.llm import collocations, url_filter
from webfrontier.llm.common import documents
from webfrontier.llm.exact_dedup import exact_groups
from webfrontier.llm.line_crf import score_documents, train
from webfrontier.llm.ngram_join import near_duplicates
from webfrontier.llm.packing import pack, token_pieces
from webfrontier.llm.piece_codec import round_trip
from webfrontier.llm.quality_rules import quality_rules
from webfrontier.llm.recompression import substring_dedup
from webfrontier.llm.secret_scan import scan_secrets
from webfrontier.llm.shingle_product import similar_sets
from webfrontier.llm.spelling import spelling_variants
from webfrontier.llm.suffix_dedup import suffix_dedup
from webfrontier.llm.token_output import read_token_blocks, token_report, write_token_blocks
from webfrontier.session import scratch_table


def vocabulary(name: str) -> str:
    """Path of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op4_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_table(spark, "token-blocks")
    write_token_blocks(documents(spark, sf_dir), path, vocabulary("word_bpe_49k.json"), end_id=2)
    return token_report(read_token_blocks(spark, path))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096)
    return pack(pieces, capacity=4096)


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train(url_filter.labelled_urls(spark))
    return url_filter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), model).drop("score")


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_ngram_join": op4_ngram_join,
    "op4_ngram_links": op4_ngram_links,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_output": op6_token_output,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_url_filter": op11_url_filter,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE: dict[str, str] = {
    "op11_url_filter": url_filter.oracle_sql(),
    "op12_phrase_mining": collocations.ORACLE,
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
}
