"""The same work on streams: discovery, live counts, and delivery of pages.

Every job works by micro-batches. A batch owns one folder of each output table and overwrites it when
it is repeated after a failure, so each result is written exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webfrontier.model import DONE, EVENT_ORDER, NEW, PROCESSING
from webfrontier.operators.callbacks import payload
from webfrontier.operators.discovery import discovered_rows, new_urls
from webfrontier.operators.links import extract_links
from webfrontier.operators.skew import heavy_keys
from webfrontier.session import cut_lineage
from webfrontier.streaming.runs import Runs

_BATCH = "batch"


def stream_discover(
    responses: DataFrame,
    seeds: DataFrame,
    policy: DataFrame,
    path: str,
    checkpoint: str,
    now: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Appends a frontier row for every new URL in a stream of responses ``(tag, url, ...)``.

    Links are reduced to distinct URLs inside the batch, before they are shuffled, so a URL that all
    pages link to is no hot spot (streaming de-duplication would send every copy to one task). Seeds
    and URLs of earlier batches are then removed by an anti join on (tag, key) with the known URLs, which lie beside the
    output in few sorted runs, however many batches there were.
    """

    spark = seeds.sparkSession
    known = known_urls(spark, f"{path.rstrip('/')}_known")
    # Read once, not with each batch.
    policy = cut_lineage(policy)

    def absorb(batch: DataFrame, batch_id: int) -> None:
        if batch_id == 0:
            known.add(-1, seeds.select("tag", "key").distinct())
        links = extract_links(batch, keep=["tag"])
        urls = new_urls(links, known.before(batch_id), policy, heavy_keys(batch, ["tag"]))
        _write(discovered_rows(urls, now), path, batch_id)
        found = spark.read.schema("tag string, key string").parquet(_folder(path, batch_id))
        known.add(batch_id, found)

    return _start(responses, absorb, checkpoint, trigger)


def known_urls(spark: SparkSession, path: str) -> Runs:
    """URLs with a row. No URL is in two runs, as each batch adds only what is in none."""
    return Runs(spark, path, "tag string, key string", ["tag", "key"], lambda rows: rows)


def latest_flags(spark: SparkSession, path: str) -> Runs:
    """The latest event of each row; ``seen`` is its place in time."""
    order = ", ".join(f"{name}:{kind}" for name, kind in zip(EVENT_ORDER, ("timestamp", "bigint")))
    schema = f"id string, tag string, flag int, seen struct<{order}>"
    return Runs(spark, path, schema, ["id"], lambda rows: _last_per_id(rows, F.col("seen")))


def moved_counts(spark: SparkSession, path: str) -> Runs:
    """What batches added to the counts; runs are added up when they are merged."""
    return Runs(spark, path, "tag string, flag int, n bigint", ["tag"], _added_up)


def _added_up(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tag", "flag").agg(F.sum("n").alias("n"))


def stream_stats(
    events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Keeps the counts per tag and flag for a stream of frontier events.

    A row that changes its state must leave its old count. So a batch is reduced to the last event
    per id and compared with the latest states of these ids, of which it reads the buckets it touches. A real change
    adds +1 for the new and -1 for the old state to the counts. States and counts are runs that are merged as they grow.
    """
    spark = events.sparkSession
    states = latest_flags(spark, f"{path.rstrip('/')}/states")
    counts = moved_counts(spark, f"{path.rstrip('/')}/counts")

    def absorb(batch: DataFrame, batch_id: int) -> None:
        last = cut_lineage(_last_per_id(batch, F.struct(*EVENT_ORDER)))
        earlier = states.before(batch_id, states.touched(last)).join(last.select("id"), "id", "left_semi")
        before = _last_per_id(earlier, F.col("seen")).select(
            "id",
            F.col("tag").alias("old_tag"),
            F.col("flag").alias("old_flag"),
            F.col("seen").alias("old_seen"),
        )
        newer = F.col("old_seen").isNull() | (F.col("seen") > F.col("old_seen"))
        changed = cut_lineage(last.join(before, "id", "left").where(newer))
        states.add(batch_id, changed)
        plus = F.struct("tag", "flag", F.lit(1).cast("bigint").alias("n"))
        minus = F.struct(
            F.col("old_tag").alias("tag"),
            F.col("old_flag").alias("flag"),
            F.lit(-1).cast("bigint").alias("n"),
        )
        moved = changed.select(F.inline(F.array(plus, minus))).where(F.col("flag").isNotNull())
        counts.add(batch_id, _added_up(moved))

    return _start(events, absorb, checkpoint, trigger)


def streamed_stats(spark: SparkSession, path: str) -> DataFrame:
    """The counts as of the last finished batch, in the form of the batch report."""
    counted = moved_counts(spark, f"{path.rstrip('/')}/counts").latest()

    def total(*flags: int):
        return F.sum(F.when(F.col("flag").isin(*flags), F.col("n")).otherwise(F.lit(0)))

    return counted.groupBy("tag").agg(
        total(DONE).alias("done"),
        total(PROCESSING).alias("processing"),
        total(NEW).alias("new"),
        total(DONE, PROCESSING, NEW).alias("total"),
    )


def stream_payload(
    responses: DataFrame,
    sites: DataFrame,
    path: str,
    checkpoint: str,
    callback: str = "search",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Writes the payload once for every finished page, failed ones included, of the sites that name the callback."""

    def deliver(batch: DataFrame, batch_id: int) -> None:
        _write(payload(batch, sites, callback), path, batch_id)

    return _start(responses, deliver, checkpoint, trigger)


def _last_per_id(events: DataFrame, order) -> DataFrame:
    return events.groupBy("id").agg(
        F.max_by("tag", order).alias("tag"),
        F.max_by("flag", order).alias("flag"),
        F.max(order).alias("seen"),
    )


def _folder(path: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/{_BATCH}={batch_id}"


def _write(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(_folder(path, batch_id))


def _start(stream: DataFrame, absorb, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    """``trigger`` has the arguments of Spark's trigger(), such as a processing time for a job that goes on;
    by default the job takes what is there and ends."""
    return (
        stream.writeStream.foreachBatch(absorb)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
