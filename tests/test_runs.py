"""Sorted runs of a stream: merging, repeated batches, what is read."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from webfrontier.streaming.jobs import known_urls, moved_counts
from webfrontier.streaming.runs import FAN, Runs


def files(runs, batch_id):
    return len(runs.before(batch_id + 1).inputFiles())


def test_files_stay_few_over_many_batches(spark, tmp_path):
    runs = Runs(spark, str(tmp_path / "runs"), "id string, n bigint", ["id"],
                lambda rows: rows.groupBy("id").agg(F.max("n").alias("n")), buckets=2)
    read = []
    for batch in range(21):
        rows = [(f"k{n}", batch) for n in range((batch + 1) % 5, 10)]
        runs.add(batch, spark.createDataFrame(rows, "id string, n bigint").coalesce(1))
        read.append(files(runs, batch))
    # 21 batches are three runs in base 4 (one of 16, one of 4, one of 1), and never more than FAN - 1 on each level.
    assert len(runs.manifest(20)) == 3 and max(read) <= 2 * 3 * (FAN - 1)
    assert read[20] <= read[2]
    expected = {f"k{n}": max(b for b in range(21) if (b + 1) % 5 <= n) for n in range(10)}
    assert {r["id"]: r["n"] for r in runs.latest().collect()} == expected
    # Only the last two manifests and their runs are left.
    assert sorted(p.name for p in Path(runs.folder.path, "manifest").glob("0*")) == [f"{n:012d}.json" for n in (19, 20)]
    assert len(list(Path(runs.folder.path).glob("run=*"))) <= 4 + 1


def test_a_repeated_batch_counts_once(spark, tmp_path):
    counts = moved_counts(spark, str(tmp_path / "counts"))
    rows = spark.createDataFrame([("t", 1, 5), ("u", 2, -1)], "tag string, flag int, n bigint")
    for batch in (0, 1, 1, 2, 2, 3, 3, 3):
        counts.add(batch, rows)
    assert {tuple(r) for r in counts.latest().collect()} == {("t", 1, 20), ("u", 2, -4)}


def test_unfinished_manifests_and_no_rows(spark, tmp_path):
    known = known_urls(spark, str(tmp_path / "known"))
    assert known.latest().isEmpty() and known.newest() == -2
    known.add(-1, spark.createDataFrame([("t", "a")], "tag string, key string"))
    known.add(0, spark.createDataFrame([], "tag string, key string"))
    known.folder.put('[["x"', "manifest", f"{1:012d}.json")
    assert known.newest() == 0 and known.latest().count() == 1


def test_only_touched_buckets_are_read(spark, tmp_path):
    known = known_urls(spark, str(tmp_path / "known"))
    known.add(0, spark.range(500).select(F.lit("t").alias("tag"), F.col("id").cast("string").alias("key")))
    one = spark.createDataFrame([("t", "7")], "tag string, key string")
    found = known.before(1, known.touched(one))
    assert 0 < found.count() < 100 and ("t", "7") in {tuple(r) for r in found.collect()}
    assert "PartitionFilters: [isnotnull(bucket" in found._jdf.queryExecution().executedPlan().toString()
