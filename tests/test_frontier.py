"""Frontier state, lookups, storage, positions and counts."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from webfrontier.model import DONE, FRONTIER, NEW, PROCESSING, SIGNATURE
from webfrontier.operators import frontier, ranking, stats
from webfrontier.operators.seeds import frontier_row

T0 = dt.datetime(2024, 1, 1)


def _rows(spark, rows):
    """Frontier rows from (tag, key, flag, seconds)."""
    made = spark.createDataFrame(
        [(t, k, f, T0 + dt.timedelta(seconds=s)) for t, k, f, s in rows],
        "tag string, key string, flag int, at timestamp",
    )
    columns = frontier_row(
        F.col("key"), F.col("tag"), F.concat(F.lit("Crawling "), "key"), F.lit("{}"), "2024-01-01"
    )
    return (
        made.select("flag", "at", *[c for c in columns if "AS flag" not in str(c)])
        .drop("datetime")
        .withColumnRenamed("at", "datetime")
    )


def test_state_follows_the_log(spark):
    rows = _rows(spark, [("t", "a", NEW, 0), ("t", "b", NEW, 0), ("t", "c", NEW, 0)])
    log = frontier.as_events(rows, "2024-01-01 00:00:00")
    log = frontier.append_events(
        log, frontier.set_flag(rows.where("key <> 'c'"), PROCESSING, "2024-01-01 00:00:01")
    )
    log = frontier.append_events(log, frontier.set_flag(rows.where("key = 'a'"), DONE, "2024-01-01 00:00:02"))
    # A late event with an old time changes nothing; of two at one time the higher number wins.
    log = frontier.append_events(log, frontier.set_flag(rows.where("key = 'a'"), NEW, "2023-01-01"))
    log = frontier.append_events(log, frontier.set_flag(rows.where("key = 'a'"), NEW, "2024-01-01 00:00:02", -1))
    state = {r["key"]: r["flag"] for r in frontier.latest_state(log).collect()}
    assert state == {"a": DONE, "b": PROCESSING, "c": NEW}
    gone = frontier.as_events(rows.where("key = 'b'"), "2024-01-02", deleted=True)
    assert {r["key"] for r in frontier.latest_state(frontier.append_events(log, gone)).collect()} == {"a", "c"}


def test_lookups(spark):
    rows = _rows(
        spark,
        [("t", "http://a.b/x", NEW, 0), ("t", "http://a.b/y", DONE, 0), ("u", "p1", SIGNATURE, 0), ("u", "z", PROCESSING, 1)],
    ).cache()
    keys = lambda df: sorted(r["key"] for r in df.collect())
    assert keys(frontier.find(rows, tag="t", flag=NEW)) == ["http://a.b/x"]
    assert keys(frontier.find(rows, searchable="a.b", tag="t")) == ["http://a.b/x", "http://a.b/y"]
    assert keys(frontier.find(rows, searchable="Crawling")) == []
    assert keys(frontier.open_rows(rows)) == ["http://a.b/x", "z"]
    assert keys(frontier.open_rows(rows, "u")) == ["z"]
    assert keys(frontier.active_crawls(rows)) == ["p1"]
    assert keys(frontier.cleanup(rows, "u")) == ["http://a.b/x", "http://a.b/y"]
    some = rows.where("key = 'z'")
    item_id = some.first()["id"]
    assert keys(frontier.by_id(rows, item_id)) == ["z"]
    assert keys(frontier.by_id(rows, "none")) == []
    assert keys(frontier.delete_ids(rows, some)) == ["http://a.b/x", "http://a.b/y", "p1"]


def test_stored_log_prunes_by_tag(spark, tmp_path):
    rows = _rows(spark, [(f"t{i % 20}", f"k{i}", NEW, i) for i in range(400)])
    path = str(tmp_path / "log")
    frontier.write_events(frontier.as_events(rows, "2024-01-01"), path)
    frontier.write_events(frontier.set_flag(rows.where("tag = 't3'"), DONE, "2024-01-02"), path)
    stored = frontier.read_events(spark, path)
    assert stored.count() == 420
    found = frontier.find(stored, tag="t3")
    assert found.count() == 40
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tag_group" in plan and "EqualTo(tag,t3)" in plan
    state = frontier.latest_state(found.drop("tag_group"))
    assert {r["flag"] for r in state.collect()} == {DONE}


@pytest.mark.parametrize("k", [1, 7, 5000])
def test_first_rows_of_each_tag(spark, k):
    data = [("big", f"k{i:05d}", NEW, i % 3) for i in range(3000)] + [("small", "x", NEW, 0), ("small", "a", NEW, 0)]
    got = frontier.next_batch(_rows(spark, data), k)
    expected = []
    for tag in ("big", "small"):
        ordered = sorted((s, key) for t, key, _, s in data if t == tag)
        expected += [(tag, key, i + 1) for i, (_, key) in enumerate(ordered[:k])]
    assert sorted((r["tag"], r["key"], r["position"]) for r in got.collect()) == sorted(expected)


@pytest.mark.parametrize("broadcast_groups", [1000, 0])
def test_positions_of_a_large_group_are_exact(spark, broadcast_groups):
    rows = spark.range(50_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("big")).otherwise(F.concat(F.lit("t"), F.col("id") % 100)).alias("tag"),
        F.xxhash64("id").alias("at"),
        "id",
    )
    ranked = ranking.ranked(rows, ["tag"], ["at", "id"], broadcast_groups=broadcast_groups)
    assert ranked.count() == 50_000
    data = sorted((r["tag"], r["at"], r["id"], r["position"]) for r in ranked.collect())
    place = {}
    for tag, _, _, position in data:
        place[tag] = place.get(tag, 0) + 1
        assert position == place[tag]


def test_counts_and_progress(spark):
    rows = _rows(spark, [("t", k, f, 0) for k, f in zip("abcde", [NEW, NEW, PROCESSING, DONE, SIGNATURE])])
    rows = rows.unionByName(_rows(spark, [("only signature", "p", SIGNATURE, 0), ("third", "a", DONE, 0)]))
    counts = stats.crawl_progress(stats.crawl_stats(rows))
    got = {r["tag"]: tuple(r)[1:] for r in counts.collect()}
    assert got == {
        "t": (1, 1, 2, 4, 25.0),
        "only signature": (0, 0, 0, 0, 0.0),
        "third": (1, 0, 0, 1, 100.0),
    }


def test_report(spark):
    crawls = spark.createDataFrame(
        [
            ("t", "label", T0, "a.b", "http", ["x", "y"], -1, None, "u", "d", False, True),
            ("w", "other", T0, "c.d", "http", [], 0, "search", None, None, True, False),
        ],
        "tag string, label string, started timestamp, domain string, scheme string, "
        "authorizedDomains array<string>, maxPages int, callback string, callbackUrl string, "
        "datasourceId string, noDiscovery boolean, ignoreSitemap boolean",
    )
    counts = stats.crawl_stats(_rows(spark, [("t", "a", DONE, 0), ("t", "b", NEW, 0), ("t", "c", NEW, 0)]))
    got = {r["tag"]: r for r in stats.crawl_report(crawls, counts).collect()}
    assert (got["t"]["max_pages"], got["t"]["authorized_domains"], got["t"]["progress"]) == ("Unlimited", "x, y", 33.33)
    assert (got["t"]["discovery"], got["t"]["sitemap"]) == (True, False)
    assert (got["w"]["max_pages"], got["w"]["total"], got["w"]["progress"]) == ("0", 0, 0.0)


def test_rows_without_an_id_get_their_own(spark):
    rows = spark.createDataFrame([(None, f"k{i}", "t", 2) for i in range(5)], "id string, key string, tag string, flag int")
    full = rows
    for name in FRONTIER.fieldNames():
        if name not in rows.columns:
            full = full.withColumn(name, F.lit(None).cast(FRONTIER[name].dataType))
    log = frontier.as_events(full, "2024-01-01 00:00:00")
    log = frontier.append_events(log, frontier.as_events(full.limit(1), "2024-01-02 00:00:00", deleted=True))
    assert frontier.latest_state(log).count() == 4


@pytest.mark.parametrize(("shift", "broadcast_groups"), [(-1, 1000), (0, 1000), (1, 1000), (0, 0)])
def test_first_rows_by_selection(spark, shift, broadcast_groups):
    """As many rows of each tag as asked for, cut within ties, at the borders of pieces and around them."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), F.col("id") % 50)).alias("tag"),
        (F.col("id") * 7919 % 101).alias("at"),
        "id",
    )
    counts = {r["tag"]: r["count"] for r in rows.groupBy("tag").count().collect()}
    keeps = {tag: max(0, [n // 2, n, 1, 0, n // 8][i % 5] + shift) for i, (tag, n) in enumerate(sorted(counts.items()))}
    limits = spark.createDataFrame(list(keeps.items()), "tag string, n long")
    found = ranking.selected(rows.join(limits, "tag"), ["tag"], ["at"], "n", broadcast_groups).collect()
    values = {tag: [] for tag in counts}
    for r in rows.collect():
        values[r["tag"]].append(r["at"])
    assert len({r["id"] for r in found}) == len(found)
    for tag, keep in keeps.items():
        assert sorted(r["at"] for r in found if r["tag"] == tag) == sorted(values[tag])[:keep]


def test_positions_take_one_exchange_of_rows(spark):
    """Rows are exchanged by range once; what is joined to them afterwards is small and broadcast."""
    rows = spark.range(1000).select((F.col("id") % 3).cast("string").alias("tag"), F.col("id").alias("key"))
    plan = ranking.ranked(rows, ["tag"], ["key"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "rangepartitioning" not in plan
