"""Exact duplicates by a tree-merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webfrontier.llm.common import NO_ID, free_name, id_back, id_column, partitions, whole_text
from webfrontier.session import cut_lineage

#: A partition takes in the runs of so many others in one round.
FAN_IN = 8
_KEY = ["digest", "n_bytes", "check"]


def _node(level: int, node: Column, piece: Column) -> Column:
    """Where a run's entry goes in a round: the low digits are those of its digest, the others stay."""
    low = FAN_IN**level
    return node - F.pmod(node, F.lit(low)) + F.pmod(piece, F.lit(low))


def exact_groups(docs: DataFrame, runs: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Documents are dealt to ``runs`` leaf runs by their id, never by their text, so a text that a third of all rows
    have is spread over all leaves. A leaf run has one entry per digest with the largest id and the count. In
    each round the runs of FAN_IN partitions exchange entries and are merged, and one more digit of the
    partition's number is taken from the digest, so that after the last round every digest has one entry in one place and no
    partition ever holds more than its share of the digests. The answers go down the same tree, where a key
    has at most FAN_IN entries below it.

    Entries are merged only if SHA-256, length and a second independent hash all agree. Texts are compared as they are,
    a null text as an empty one. Of equal texts the largest doc_id stays; a null doc_id is below all others, and a
    group of null ids keeps null. Repeated rows count in group_size, and each of them reports the same result.
    """
    spark = docs.sparkSession
    wanted = runs or partitions(spark)
    rounds = 1
    while FAN_IN**rounds < wanted:
        rounds += 1
    leaves = FAN_IN**rounds
    text = whole_text()
    rows = docs.select(
        id_column().alias("doc_id"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(text).alias("check"),
    ).withColumn("node", F.pmod(F.xxhash64("doc_id"), F.lit(leaves)))
    piece = F.pmod(F.xxhash64("digest"), F.lit(leaves))

    level = rows.groupBy("node", *_KEY).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    levels = [cut_lineage(level.sortWithinPartitions("node", "digest"))]
    for number in range(1, rounds + 1):
        sent = levels[-1].withColumn("node", _node(number, F.col("node"), piece))
        merged = sent.groupBy("node", *_KEY).agg(
            F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
        )
        levels.append(cut_lineage(merged.sortWithinPartitions("node", "digest")))

    answers = levels[-1].filter("group_size > 1")
    for number in range(rounds, 0, -1):
        below = levels[number - 1].select(
            F.col("node").alias("child"), _node(number, F.col("node"), piece).alias("node"), *_KEY
        )
        answers = below.join(answers, ["node", *_KEY]).select(
            F.col("child").alias("node"), *_KEY, "keep_id", "group_size"
        )
    keep = F.coalesce("keep_id", "doc_id")
    return rows.join(answers, ["node", *_KEY], "left").select(
        id_back(),
        F.when(keep != NO_ID, keep).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (keep == F.col("doc_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents of which exact_groups says that they stay, with all their columns; of repeated rows one stays."""
    own, digest = free_name(docs, "_own"), free_name(docs, "_digest")
    marks = exact_groups(docs).filter("kept OR keep_id IS NULL")
    marks = marks.select(id_column().alias(own), F.col("text_sha256").alias(digest)).distinct()
    tagged = docs.withColumn(own, id_column()).withColumn(digest, F.sha2(whole_text().cast("binary"), 256))
    return tagged.join(marks, [own, digest], "left_semi").dropDuplicates([own, digest]).drop(own, digest)
