"""A stored frontier: immutable folders of events, and a manifest that says which of them count.

Below the store's path lie ``data/folder=<name>/tag_group=<n>``, ``index/folder=<name>/bucket=<n>`` and
``manifest/<version>.json``. Folders are written under new names and never changed. A version of the
store is one small manifest, made by an exclusive create, so a change takes place as a whole or not at all, and
readers of an older version keep what they had. A row's events lie in the group of its tag; a rewrite touches only the groups it is
for, the manifest names the same folders for all others.

The index has a row ``(term, tag_group, id)`` for each id and each token of the text columns. It tells which groups a
lookup has to read. An entry may be out of date; what it leads to is always tested again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webfrontier.functions.text import search_tokens
from webfrontier.model import FRONTIER
from webfrontier.operators.frontier import TEXT_COLUMNS, find, latest_state, row_id, tag_group, with_ids
from webfrontier.sources.folders import Folder

EVENTS = T.StructType(
    [
        *FRONTIER.fields,
        T.StructField("event_time", T.TimestampType()),
        T.StructField("event_no", T.LongType()),
        T.StructField("deleted", T.BooleanType()),
    ]
)
# Folders the index is split into by term.
INDEX_BUCKETS = 64
_INDEX = "term string, tag_group int, id string, bucket int"


class Conflict(Exception):
    """Another writer changed the store in the meantime."""


@dataclass(frozen=True)
class Manifest:
    """What counts: the folders of each group, and those of the index.

    ``moved`` says that some id has events in more than one group (it was stored again under another tag). Then a
    group alone doesn't tell the latest state of its rows; a compaction of all groups ends that.
    """

    version: int = 0
    #: The number the next version must have, so that no change in between is lost.
    following: int = 1
    groups: dict[int, list[str]] = field(default_factory=dict)
    index: list[str] = field(default_factory=list)
    moved: bool = False

    def to_json(self) -> str:
        groups = {str(group): names for group, names in sorted(self.groups.items())}
        return json.dumps({"groups": groups, "index": self.index, "moved": self.moved})


class FrontierStore:
    """Writers and readers of one path; any number of readers, and writers that may conflict."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = Folder(spark, path)

    # --- manifest ---

    def _numbers(self) -> list[int]:
        names = self.folder.names("manifest")
        return sorted((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), reverse=True)

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest version, or the named one. One that its writer did not finish doesn't count."""
        numbers = self._numbers()
        for number in numbers if version is None else [version]:
            try:
                read = json.loads(self.folder.text("manifest", f"{number:012d}.json"))
            except json.JSONDecodeError:
                continue
            groups = {int(group): names for group, names in read["groups"].items()}
            return Manifest(number, max(numbers) + 1, groups, read["index"], read["moved"])
        return Manifest(following=max(numbers, default=0) + 1)

    def _commit(self, manifest: Manifest) -> int:
        if not self.folder.put(manifest.to_json(), "manifest", f"{manifest.following:012d}.json"):
            raise Conflict(f"version {manifest.following} of {self.path} was written by another job")
        return manifest.following

    # --- writing ---

    def _write(self, events: DataFrame) -> tuple[str, list[int]]:
        """Writes a folder of events: its name and its groups."""
        name = uuid.uuid4().hex
        rows = events.select(*[F.col(f.name).cast(f.dataType) for f in EVENTS], tag_group(F.col("tag")).alias("tag_group"))
        (
            rows.hint("rebalance", F.col("tag_group"))
            .sortWithinPartitions("tag_group", "tag", "key")
            .write.partitionBy("tag_group")
            .option("parquet.bloom.filter.enabled#id", "true")
            .parquet(f"{self.path}/data/folder={name}")
        )
        folders = self.folder.names("data", f"folder={name}")
        return name, sorted(int(f.removeprefix("tag_group=")) for f in folders if f.startswith("tag_group="))

    def _write_index(self, events: DataFrame) -> str:
        name = uuid.uuid4().hex
        terms = [F.array(_term("id", F.col("id")))]
        for column in sorted(TEXT_COLUMNS):
            tokens = F.coalesce(search_tokens(F.col(column)), F.array().cast("array<string>"))
            terms.append(F.transform(F.array_distinct(tokens), _of(column)))
        rows = events.select(F.explode(F.concat(*terms)).alias("term"), "tag_group", "id").distinct()
        (
            rows.withColumn("bucket", _bucket(F.col("term")))
            .hint("rebalance", F.col("bucket"))
            .sortWithinPartitions("bucket", "term")
            .write.partitionBy("bucket")
            .option("parquet.bloom.filter.enabled#term", "true")
            .parquet(f"{self.path}/index/folder={name}")
        )
        return name

    def append(self, events: DataFrame) -> int:
        """Adds events; the number of the new version. Repeated when another writer was faster, since nothing is taken away."""
        name, groups = self._write(with_ids(events))
        written = self._read({group: [name] for group in groups})
        index = self._write_index(written)
        while True:
            old = self.manifest()
            moved = old.moved or self._moves(written, old, index)
            merged = dict(old.groups)
            for group in groups:
                merged[group] = [*merged.get(group, []), name]
            try:
                return self._commit(replace(old, groups=merged, index=[*old.index, index], moved=moved))
            except Conflict:
                continue

    def _moves(self, written: DataFrame, old: Manifest, index: str) -> bool:
        """Whether an id of these events lies in more than one group, here or in what was there before. Ids that follow from
        tag and key can't, so the index is read only when others were given."""
        written = written.where(~F.col("id").eqNullSafe(row_id(F.col("tag"), F.col("key"))))
        if written.isEmpty():
            return False
        places = self._read_index([*old.index, index]).where(F.col("term").startswith(_term("id", "")))
        known = places.join(written.select("id").distinct(), "id", "left_semi")
        return not known.groupBy("id").agg(F.count_distinct("tag_group").alias("n")).where("n > 1").isEmpty()

    def compact(self, groups: Iterable[int] | None = None) -> int:
        """Rewrites groups, all by default, to one event per row: the latest. The number of the new version.

        Tombstones go too, but for some groups alone only while no id has events in several groups.
        """
        old = self.manifest()
        every = groups is None
        chosen = sorted(old.groups) if every else sorted(set(groups) & set(old.groups))
        rows = self._read({group: old.groups[group] for group in chosen})
        latest = _last_events(rows)
        if every or not old.moved:
            latest = _alive(latest)
        return self._replace(old, chosen, latest, fresh_index=every)

    def drop_tag(self, tag: str | None) -> int:
        """Removes all rows of a tag, the signature too, by a rewrite of the tag's group; the number of the new version."""
        old = self.manifest()
        if old.moved:
            self.compact()
            old = self.manifest()
        group = self._group(tag)
        if group not in old.groups:
            return old.version
        kept = _alive(_last_events(self._read({group: old.groups[group]}))).where(~F.col("tag").eqNullSafe(F.lit(tag)))
        return self._replace(old, [group], kept, fresh_index=False)

    def _replace(self, old: Manifest, chosen: list[int], events: DataFrame, fresh_index: bool) -> int:
        name, written = self._write(events)
        groups = {group: names for group, names in old.groups.items() if group not in chosen}
        groups |= {group: [name] for group in written}
        index = old.index
        if fresh_index:
            index = [self._write_index(self._read({group: [name] for group in written}))] if written else []
        return self._commit(replace(old, groups=groups, index=index, moved=old.moved and not fresh_index))

    def expire(self, keep: int = 1) -> list[str]:
        """Deletes manifests but the newest ``keep``, and folders that none of these names. Run it while nothing writes and no older
        version is read. The names of the folders that went."""
        numbers = self._numbers()
        kept = [self.manifest(number) for number in numbers[:keep]]
        used = {name for m in kept for names in [*m.groups.values(), m.index] for name in names}
        gone = []
        for part in ("data", "index"):
            for name in [n.removeprefix("folder=") for n in self.folder.names(part)]:
                if name not in used:
                    self.folder.drop(part, f"folder={name}")
                    gone.append(name)
        for number in numbers[keep:]:
            self.folder.drop("manifest", f"{number:012d}.json")
        return gone

    # --- reading ---

    def _group(self, tag: str | None) -> int:
        return self.spark.range(1).select(tag_group(F.lit(tag).cast("string"))).first()[0]

    def _read(self, groups: dict[int, list[str]]) -> DataFrame:
        schema = T.StructType([*EVENTS.fields, T.StructField("tag_group", T.IntegerType())])
        paths = [f"{self.path}/data/folder={name}/tag_group={group}" for group, names in groups.items() for name in names]
        if not paths:
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(schema).option("basePath", f"{self.path}/data")
        return read.parquet(*paths).select(*schema.fieldNames())

    def _read_index(self, names: list[str], terms: list[str] | None = None) -> DataFrame:
        """Rows of the index, of the buckets of some terms or of all."""
        if not names:
            return self.spark.createDataFrame([], _INDEX)
        read = self.spark.read.schema(_INDEX).option("basePath", f"{self.path}/index")
        rows = read.parquet(*[f"{self.path}/index/folder={name}" for name in names])
        if terms is not None:
            rows = rows.where(F.col("bucket").isin([self._bucket_of(t) for t in terms]) & F.col("term").isin(terms))
        return rows

    def _bucket_of(self, term: str) -> int:
        return self.spark.range(1).select(_bucket(F.lit(term))).first()[0]

    def events(self, version: int | None = None, tag: str | None = None) -> DataFrame:
        """Events that count, of one tag's group only when a tag is given (rows of other tags may be among them)."""
        manifest = self.manifest(version)
        groups = manifest.groups
        if tag is not None and not manifest.moved:
            group = self._group(tag)
            groups = {group: groups[group]} if group in groups else {}
        return self._read(groups).drop("tag_group")

    def state(self, version: int | None = None) -> DataFrame:
        """The latest state of all rows."""
        return latest_state(self.events(version))

    def lookup(self, version: int | None = None, **terms) -> DataFrame:
        """The latest state of the rows that match all terms, as ``find`` does it.

        An id, and one token of a text column, are looked up in the index, so that only groups where they are found are
        read, and only those ids are reduced. A tag alone reads its group.
        """
        manifest = self.manifest(version)
        groups = manifest.groups
        # The state of a row follows from all its events; while all lie in one group, the filter may come first.
        indexed = [_term(c, str(v)) for c, v in terms.items() if c in {"id", *TEXT_COLUMNS} and v is not None]
        if "tag" in terms and not manifest.moved:
            group = self._group(terms["tag"])
            groups = {group: groups[group]} if group in groups else {}
        ids = None
        for term in indexed:
            found = self._read_index(manifest.index, [term]).select("id", "tag_group")
            if not manifest.moved:
                found = found.where(F.col("tag_group").isin(list(groups)))
            ids = found.select("id") if ids is None else ids.join(found.select("id"), "id", "left_semi")
            if not manifest.moved:
                there = {r["tag_group"] for r in found.select("tag_group").distinct().collect()}
                groups = {group: names for group, names in groups.items() if group in there}
        rows = self._read(groups).drop("tag_group")
        if "id" in terms:
            rows = rows.where(F.col("id") == terms["id"])
        elif "tag" in terms and not manifest.moved:
            rows = rows.where(F.col("tag").eqNullSafe(F.lit(terms["tag"])))
        if ids is not None and "id" not in terms:
            rows = rows.join(ids.distinct(), "id", "left_semi")
        return find(latest_state(rows), **terms)


def _term(column: str, value: str | Column):
    return F.concat(F.lit(f"{column}:"), value) if isinstance(value, Column) else f"{column}:{value}"


def _of(column: str):
    return lambda token: _term(column, token)


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(INDEX_BUCKETS)).cast("int")


def _alive(events: DataFrame) -> DataFrame:
    return events.where(~F.coalesce("deleted", F.lit(False)))


def _last_events(rows: DataFrame) -> DataFrame:
    order = F.struct("event_time", "event_no")
    columns = [name for name in EVENTS.fieldNames() if name != "id"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*columns), order).alias("last")).select("id", "last.*")
