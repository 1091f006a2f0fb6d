"""The stored frontier: versions, compaction, cleanup of a tag, lookups through the index, ids."""

from __future__ import annotations

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from webfrontier.model import DONE, NEW, PROCESSING
from webfrontier.operators import frontier
from webfrontier.operators.store import EVENTS, Conflict, FrontierStore

FIELDS = "id string, tag string, key string, flag int, searchable string, event_no long, deleted boolean"


def events(spark, rows):
    """Events from (id, tag, key, flag, searchable, event_no, deleted)."""
    made = spark.createDataFrame(rows, FIELDS)
    for field in EVENTS:
        if field.name not in made.columns:
            value = F.lit("2024-01-01").cast("timestamp") if field.name == "event_time" else F.lit(None).cast(field.dataType)
            made = made.withColumn(field.name, value)
    return made


def row(tag, key, flag=NEW, no=0, text="", item=None, deleted=False):
    return (item, tag, key, flag, text, no, deleted)


def shown(state):
    return sorted((r["tag"], r["key"], r["flag"]) for r in state.collect())


def digests(path, group):
    files = Path(path, "data").glob(f"folder=*/tag_group={group}/*.parquet")
    return {f.name: hashlib.sha256(f.read_bytes()).hexdigest() for f in files}


@pytest.fixture
def store(spark, tmp_path):
    store = FrontierStore(spark, str(tmp_path / "store"))
    store.append(events(spark, [row(f"t{n % 6}", f"k{n}", text=f"Page {n} word{n % 3}") for n in range(60)]))
    store.append(events(spark, [row(f"t{n % 6}", f"k{n}", DONE, 1, f"Page {n} new{n % 3}") for n in range(0, 60, 2)]))
    store.append(events(spark, [row("t1", "k1", no=2, deleted=True), row("t2", "k2", no=2, deleted=True)]))
    return store


def expected(tags=range(6), gone=("k1", "k2")):
    rows = [(f"t{n % 6}", f"k{n}", NEW if n % 2 else DONE) for n in range(60) if n % 6 in tags]
    return sorted(r for r in rows if r[1] not in gone)


def test_appends_and_compaction(spark, store):
    assert shown(store.state()) == expected()
    before, old = store.manifest(), store.events(3)
    assert (before.version, store.compact()) == (3, 4)
    assert shown(store.state()) == expected()
    # One event per row is left, without tombstones; the old version is still there for its readers.
    assert (store.events().count(), old.count(), store.events(3).count()) == (58, 92, 92)
    assert {len(names) for names in store.manifest().groups.values()} == {1}
    assert shown(store.state(1)) == sorted((f"t{n % 6}", f"k{n}", NEW) for n in range(60))


def test_drop_tag_leaves_other_groups_alone(spark, store):
    group = {f"t{n}": store._group(f"t{n}") for n in range(6)}
    others = {g for g in group.values() if g != group["t1"]}
    before, manifest = {g: digests(store.path, g) for g in others}, store.manifest()
    reader = store.state()
    store.drop_tag("t1")
    after = store.manifest()
    assert shown(store.state()) == expected(tags=[0, 2, 3, 4, 5])
    assert {g: digests(store.path, g) for g in others} == before
    assert {g: after.groups[g] for g in others} == {g: manifest.groups[g] for g in others}
    assert shown(reader) == expected()
    assert shown(store.lookup(tag="t1")) == [] and store.drop_tag("absent") == store.manifest().version
    # Rows of a dropped tag can come again.
    store.append(events(spark, [row("t1", "k1", PROCESSING)]))
    assert shown(store.lookup(tag="t1")) == [("t1", "k1", PROCESSING)]


def test_compaction_of_one_group(spark, store):
    group = store._group("t2")
    others = {g: names for g, names in store.manifest().groups.items() if g != group}
    store.compact([group, 1000])
    after = store.manifest().groups
    assert len(after[group]) == 1 and {g: after[g] for g in others} == others
    assert shown(store.state()) == expected()


def test_lookups_read_what_the_index_names(spark, store):
    found = store.lookup(tag="t4", searchable="new1")
    assert shown(found) == [("t4", f"k{n}", DONE) for n in (10, 16, 22, 28, 34, 4, 40, 46, 52, 58)]
    # The word was replaced in the rows that are done.
    assert shown(store.lookup(searchable="word0")) == [r for r in expected() if int(r[1][1:]) % 3 == 0 and r[2] == NEW]
    assert shown(store.lookup(searchable="nowhere")) == []
    item = store.lookup(tag="t3").where("key = 'k9'").first()["id"]
    by_id = store.lookup(id=item)
    assert shown(by_id) == [("t3", "k9", NEW)]
    plan = by_id._jdf.queryExecution().executedPlan().toString()
    assert f"tag_group={store._group('t3')}" in str(by_id.inputFiles()) and len(by_id.inputFiles()) <= 3
    assert "EqualTo(id," in plan
    index = store._read_index(store.manifest().index, ["id:x"])
    assert "PartitionFilters: [isnotnull(bucket" in index._jdf.queryExecution().executedPlan().toString()
    # The filter comes before the events are reduced.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join LeftSemi")


def test_rows_that_move_to_another_tag(spark, tmp_path):
    store = FrontierStore(spark, str(tmp_path / "moving"))
    store.append(events(spark, [row("a", "x", item="one", text="red"), row("b", "y", item="two", text="red"), row("b", "z", item="three")]))
    assert not store.manifest().moved
    store.append(events(spark, [row("b", "x", DONE, 1, "blue", item="one"), row("a", "y", no=1, item="two", text="red")]))
    assert store.manifest().moved
    assert shown(store.state()) == [("a", "y", NEW), ("b", "x", DONE), ("b", "z", NEW)]
    assert shown(store.lookup(searchable="red")) == [("a", "y", NEW)]
    assert shown(store.lookup(tag="a")) == [("a", "y", NEW)]
    store.compact([store._group("a")])
    assert shown(store.state()) == [("a", "y", NEW), ("b", "x", DONE), ("b", "z", NEW)]
    # "one" belongs to b now, so its older version under a must not come back.
    store.drop_tag("b")
    assert shown(store.state()) == [("a", "y", NEW)]
    assert not store.manifest().moved


def test_conflicts_and_unfinished_versions(spark, store):
    old = store.manifest()
    store.compact()
    with pytest.raises(Conflict):
        store._commit(old)
    store.folder.put('{"groups": {', "manifest", f"{store.manifest().following:012d}.json")
    assert store.manifest().version == 4 and shown(store.state()) == expected()
    assert store.append(events(spark, [row("t0", "new")])) == 6
    assert len(shown(store.state())) == 59


def test_expire(store):
    store.compact()
    gone = store.expire()
    assert len(gone) == 6 and shown(store.state()) == expected()
    assert [int(p.name[:12]) for p in Path(store.path, "manifest").glob("*.json")] == [4]
    assert shown(store.lookup(searchable="new1", tag="t4"))


def test_empty_store(spark, tmp_path):
    store = FrontierStore(spark, str(tmp_path / "empty"))
    assert shown(store.state()) == [] and shown(store.lookup(id="x")) == [] and store.expire() == []
    store.append(events(spark, []))
    store.compact()
    assert shown(store.state()) == [] and store.drop_tag(None) == 2


def test_ids_tell_rows_apart(spark, tmp_path):
    """Missing and empty parts, a bar in a part, and rows without tag and key, which are all rows of their own."""
    keys = [(None, "a"), ("a", None), (None, None), (None, None), ("x|y", "z"), ("x", "y|z"), ("", "a"), ("a", "")]
    store = FrontierStore(spark, str(tmp_path / "ids"))
    store.append(events(spark, [row(tag, key) for tag, key in keys]))
    store.append(events(spark, [row(tag, key, DONE, 1) for tag, key in keys[:2]]))
    found = [(r["tag"], r["key"], r["flag"]) for r in store.state().collect()]
    assert sorted(map(str, found)) == sorted(str((t, k, NEW if n > 1 else DONE)) for n, (t, k) in enumerate(keys))
    rows = spark.createDataFrame(keys, "tag string, key string")
    assert rows.select(frontier.row_id(F.col("tag"), F.col("key"))).distinct().count() == 7
