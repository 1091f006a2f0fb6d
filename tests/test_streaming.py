"""Streams over several micro-batches give what the batch jobs give."""

from __future__ import annotations

import pytest
from conftest import SF
from pyspark.sql import functions as F

from webfrontier.operators import callbacks, links, stats
from webfrontier.operators.frontier import latest_state
from webfrontier.plans import derived as D
from webfrontier.plans import queries
from webfrontier.sources import responses
from webfrontier.streaming import jobs


@pytest.fixture(scope="module")
def pages(spark):
    return D.table(spark, SF, "pages")


def _stream(spark, table, path):
    """The table as a stream of several micro-batches, with every row of one part repeated."""
    table.repartition(3).write.parquet(path)
    table.where(F.expr(f"{table.columns[0]} % 4 = 0")).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _same(a, b):
    columns = sorted(a.columns)
    assert sorted(b.columns) == columns
    rows = [sorted(map(repr, x.select(columns).collect())) for x in (a, b)]
    assert rows[0] == rows[1] and rows[0]


def test_discovery(spark, pages, tmp_path):
    policy = links.site_policy(D.sites(pages), D.robots(pages)).cache()
    known = pages.select(D.crawl_tag(D.url_domain(F.col("url")), D.PREFIX).alias("tag"), F.col("url").alias("key"))
    query = jobs.stream_discover(
        D.responses(_stream(spark, pages, str(tmp_path / "in"))),
        known,
        policy,
        str(tmp_path / "out"),
        str(tmp_path / "progress"),
        D.NOW,
    )
    query.awaitTermination()
    assert query.lastProgress["batchId"] >= 3
    batch = links.allowed_links(links.extract_links(D.responses(pages), keep=["tag"]), policy)
    expected = batch.select("tag", F.col("link").alias("key")).distinct().join(known, ["tag", "key"], "left_anti")
    _same(spark.read.parquet(str(tmp_path / "out")).select("tag", "key"), expected)


def test_counts(spark, tmp_path):
    events = D.table(spark, SF, "events")
    stream = D.frontier_events(_stream(spark, events, str(tmp_path / "in")))
    query = jobs.stream_stats(stream, str(tmp_path / "out"), str(tmp_path / "progress"))
    query.awaitTermination()
    assert query.lastProgress["batchId"] >= 3
    expected = stats.crawl_stats(latest_state(D.frontier_events(events)))
    _same(jobs.streamed_stats(spark, str(tmp_path / "out")), expected)


def test_a_row_that_moves_leaves_its_old_count(spark, tmp_path):
    schema = "id string, tag string, flag int, event_time timestamp, event_no bigint"
    path = str(tmp_path / "in")
    batches = [
        [("a", "t", 2, 1), ("b", "t", 2, 1), ("a", "t", 1, 2)],
        [("a", "t", 0, 3), ("b", "t", 2, 0)],
        [("a", "t", 1, 2), ("b", "u", 1, 9)],
    ]
    for rows in batches:
        table = spark.createDataFrame(rows, "id string, tag string, flag int, event_no bigint")
        table.withColumn("event_time", F.timestamp_seconds("event_no")).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        jobs.stream_stats(stream, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    got = {r["tag"]: tuple(r)[1:] for r in jobs.streamed_stats(spark, str(tmp_path / "out")).collect()}
    assert got == {"t": (1, 0, 0, 1), "u": (0, 1, 0, 1)}


def test_stored_responses_as_a_stream(spark, pages, tmp_path):
    table = responses.pages_to_responses(pages)
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = links.extract_links(responses.stream_responses(spark, str(tmp_path / "in"), 1))
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "progress"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    _same(spark.read.parquet(str(tmp_path / "out")), links.extract_links(table))


def test_delivery(spark, pages, tmp_path):
    settings = D.sites(pages).cache()
    rows = pages.where("page_id % 4 <> 0")
    jobs.stream_payload(
        D.responses(_stream(spark, rows.select("page_id", "url", "html"), str(tmp_path / "in"))),
        settings,
        str(tmp_path / "out"),
        str(tmp_path / "progress"),
    ).awaitTermination()
    _same(spark.read.parquet(str(tmp_path / "out")).drop("batch"), callbacks.payload(D.responses(rows), settings, "search"))


def test_no_task_reads_the_whole_table_for_a_stream(spark, tmp_path):
    """Every task writes a file of its own for each of the four batches."""
    table = spark.range(4000).selectExpr("id AS page_id", "concat('u', id) AS url").repartition(4)
    table.write.parquet(str(tmp_path / "pages.parquet"))
    parts = D.table(spark, str(tmp_path), "pages").rdd.getNumPartitions()
    assert parts > 1
    seen = []

    def note(batch, batch_id):
        rows = batch.select("page_id", F.input_file_name().alias("file")).collect()
        seen.append(([r["page_id"] for r in rows], len({r["file"] for r in rows})))

    stream = queries._stream(spark, str(tmp_path), "pages", F.col("page_id") % 4 == 0)
    progress = str(tmp_path / "progress")
    stream.writeStream.foreachBatch(note).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    assert [files for _, files in seen] == [parts] * 4
    assert sorted(i for ids, _ in seen[:3] for i in ids) == list(range(4000))
    assert sorted(seen[3][0]) == list(range(0, 4000, 4))
