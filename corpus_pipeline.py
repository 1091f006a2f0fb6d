"""The corpus pipeline: documents of poor quality go, copies and near copies go, secrets are blotted out, the rest is packed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webfrontier.llm.exact_dedup import drop_copies
from webfrontier.llm.line_crf import accepted, train
from webfrontier.llm.ngram_join import drop_near_copies
from webfrontier.llm.packing import pack, token_pieces
from webfrontier.llm.queries import vocabulary
from webfrontier.llm.secret_scan import redact_secrets
from webfrontier.session import scratch_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier accepts. It learns from the labelled documents among those of this stage.

    A null text counts as an empty one. Without labels of both kinds every score is 0.5 and all documents stay. Repeated rows are
    judged alike.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return accepted(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id; of repeated rows one. A null text equals an empty one."""
    return drop_copies(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of similar documents, the one with the smallest doc_id. Texts without words are similar to nothing."""
    return drop_near_copies(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark; null and empty texts stay as they are."""
    return redact_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences of 4096 tokens. A null or empty text is its end id alone."""
    return pack(token_pieces(docs, vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096), capacity=4096)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("ngram_join", ngram_join),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Learned scores, similarity of sets and tokenizers are beyond SQL: a test compares run() with a plain version of the stages instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what a stage returns is written and read again for the next one.

    An empty table gives no pieces. Columns of any name besides doc_id and text are passed on up to the last stage.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_table(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
