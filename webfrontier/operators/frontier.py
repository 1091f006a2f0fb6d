"""The frontier: an append-only log of row versions, its latest state, and lookups on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webfrontier.functions.text import search_tokens
from webfrontier.model import EVENT_ORDER, FRONTIER, NEW, PROCESSING, SIGNATURE
from webfrontier.operators.ranking import first_rows, ranked

# Analysed columns: a term matches one of their tokens. All others match as a whole.
TEXT_COLUMNS = {"searchable", "data"}
# Folders a stored frontier is split into; a tag lives in one of them.
TAG_GROUPS = 64


def row_id(tag: Column, key: Column) -> Column:
    """Stable id of a frontier row: the tag goes in with its length, and a missing part differs from an empty one."""
    text = F.concat(
        F.coalesce(F.concat(F.length(tag).cast("string"), F.lit(":"), tag), F.lit("-")),
        F.coalesce(F.concat(F.lit("|"), key), F.lit("-")),
    )
    return F.sha2(text, 256)


def tag_group(tag: Column) -> Column:
    return F.pmod(F.xxhash64(tag), F.lit(TAG_GROUPS)).cast("int")


def as_events(rows: DataFrame, event_time: str, event_no: int = 0, deleted: bool = False) -> DataFrame:
    """Row versions as of one moment, or tombstones with ``deleted``. A row without an id gets its stable one."""
    return rows.select(
        _id_or_own().alias("id"),
        *[name for name in FRONTIER.fieldNames() if name != "id"],
        F.to_timestamp(F.lit(event_time)).alias("event_time"),
        F.lit(event_no).cast("bigint").alias("event_no"),
        F.lit(deleted).alias("deleted"),
    )


def append_events(log: DataFrame, events: DataFrame) -> DataFrame:
    return log.unionByName(with_ids(events), allowMissingColumns=True)


def with_ids(rows: DataFrame) -> DataFrame:
    return rows.withColumn("id", _id_or_own())


def _id_or_own() -> Column:
    """The given id, else the stable one. Rows without tag and key are rows of their own: nothing says that two are the same."""
    nameless = F.col("tag").isNull() & F.col("key").isNull()
    return F.coalesce("id", F.when(nameless, F.uuid()).otherwise(row_id(F.col("tag"), F.col("key"))))


def set_flag(rows: DataFrame, flag: int, event_time: str, event_no: int = 0) -> DataFrame:
    """Events that move the given rows to another state."""
    return as_events(rows.withColumn("flag", F.lit(flag)), event_time, event_no)


def latest_state(
    events: DataFrame, order: list[str] | None = None, keep: list[str] | None = None
) -> DataFrame:
    """The last version per id without tombstones; versions are reduced before they are shuffled.

    ``keep`` names the columns that are needed, when these are few: no others are read or shuffled.
    """
    order = order or EVENT_ORDER
    wanted = events.columns if keep is None else [*keep, "deleted"]
    columns = [c for c in events.columns if c in wanted and c not in [*order, "id"]]
    last = F.max_by(F.struct(*columns), F.struct(*order)).alias("last")
    # The id is the grouping key itself, so a filter on it reaches the scan.
    state = events.groupBy("id").agg(last).select("id", "last.*")
    if "deleted" in columns:
        state = state.where(~F.coalesce("deleted", F.lit(False))).drop("deleted")
    return state


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Writes by tag group and sorted by tag, so that a lookup by tag reads few files and row groups.

    The rebalance hint lets Spark split a large group over many files and join small ones.
    """
    (
        events.withColumn("tag_group", tag_group(F.col("tag")))
        .hint("rebalance", F.col("tag_group"))
        .sortWithinPartitions("tag_group", "tag", "key")
        .write.mode(mode)
        .partitionBy("tag_group")
        .parquet(path)
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def find(frontier: DataFrame, **terms) -> DataFrame:
    """Rows that match all terms; on text columns a term must equal one lowercased token."""
    for name, value in terms.items():
        if name in TEXT_COLUMNS:
            frontier = frontier.where(F.array_contains(search_tokens(F.col(name)), F.lit(value)))
        else:
            frontier = frontier.where(F.col(name) == F.lit(value))
        if name == "tag" and "tag_group" in frontier.columns:
            frontier = frontier.where(F.col("tag_group") == tag_group(F.lit(value)))
    return frontier


def by_id(frontier: DataFrame, item_id: str) -> DataFrame:
    return frontier.where(F.col("id") == item_id).limit(1)


def open_rows(frontier: DataFrame, tag: str | None = None) -> DataFrame:
    """Rows not finished yet: new or in processing."""
    rows = frontier.where(F.col("flag").isin(NEW, PROCESSING))
    return rows if tag is None else find(rows, tag=tag)


def fifo(frontier: DataFrame) -> DataFrame:
    """Rows with their place in the queue of their tag, oldest first, ties by key."""
    return ranked(frontier, ["tag"], ["datetime", "key"])


def next_batch(frontier: DataFrame, k: int) -> DataFrame:
    """The ``k`` oldest new rows of every tag."""
    return first_rows(frontier.where(F.col("flag") == NEW), ["tag"], ["datetime", "key"], k)


def delete_ids(frontier: DataFrame, ids: DataFrame) -> DataFrame:
    return frontier.join(ids.select("id"), "id", "left_anti")


def cleanup(frontier: DataFrame, tag: str) -> DataFrame:
    """Removes a run: its signature and all its rows."""
    kept = ~F.col("tag").eqNullSafe(F.lit(tag))
    return frontier.where(kept)


def active_crawls(frontier: DataFrame) -> DataFrame:
    """Signature rows, one per run."""
    return frontier.where(F.col("flag") == SIGNATURE)
