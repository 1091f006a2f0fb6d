"""Keyed rows that grow by micro-batches: sorted runs in hash buckets, merged level by level.

A batch adds one run. When a level has FAN runs, they are merged into one run of the next level, so after n batches there are at most
(FAN - 1) * log(n) runs, and a row is rewritten once per level. Every run lies in folders by bucket, sorted by key within
them; a reader names the buckets it needs.

A batch has one manifest with the runs that count after it. It starts from the manifest of the batch before, so a
batch that is repeated after a failure does the same again. Runs that the last two manifests don't name are removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webfrontier.sources.folders import Folder

FAN = 4
BUCKETS = 16


class Runs:
    """``merge`` makes one row per key of the rows of several runs; ``schema`` is that of a run, with the ``keys`` in it."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str],
                 merge: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS):
        self.spark, self.folder, self.keys, self.merge, self.buckets = spark, Folder(spark, path), keys, merge, buckets
        self.schema = T._parse_datatype_string(schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that the keys of some rows lie in: at most as many as there are buckets."""
        return [r[0] for r in rows.select(self.bucket().alias("bucket")).distinct().collect()]

    def manifest(self, batch_id: int) -> list[tuple[str, int]]:
        """Name and level of the runs after a batch; none where it has no manifest."""
        name = f"{batch_id:012d}.json"
        if name not in self.folder.names("manifest"):
            return []
        return [tuple(run) for run in json.loads(self.folder.text("manifest", name))]

    def newest(self) -> int:
        """The last batch with a finished manifest, -2 without one (-1 stands for what was there before the first batch)."""
        for name in sorted(self.folder.names("manifest"), key=lambda n: int(n[:12]) if n.endswith(".json") else -9, reverse=True):
            try:
                json.loads(self.folder.text("manifest", name))
                return int(name.removesuffix(".json"))
            except json.JSONDecodeError:
                continue
        return -2

    def _read(self, runs: list[tuple[str, int]], buckets: list[int] | None = None) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        schema = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        read = self.spark.read.schema(schema).option("basePath", self.folder.path)
        rows = read.parquet(*[f"{self.folder.path}/run={name}" for name, _ in runs])
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        return rows.select(*self.schema.fieldNames())

    def before(self, batch_id: int, buckets: list[int] | None = None) -> DataFrame:
        """Rows of all runs before a batch, of some buckets or of all; a key can be in several runs."""
        return self._read(self.manifest(batch_id - 1), buckets)

    def latest(self) -> DataFrame:
        return self.merge(self._read(self.manifest(self.newest())))

    def _write(self, rows: DataFrame, batch_id: int) -> str:
        name = f"{batch_id}-{uuid.uuid4().hex}"
        (
            rows.select(*self.schema.fieldNames())
            .withColumn("bucket", self.bucket())
            .repartition("bucket")
            .sortWithinPartitions("bucket", *self.keys)
            .write.partitionBy("bucket")
            .parquet(f"{self.folder.path}/run={name}")
        )
        return name

    def add(self, batch_id: int, rows: DataFrame) -> None:
        """Adds the rows of a batch, one per key, as a run; merges full levels; makes it count."""
        base = self.manifest(batch_id - 1)
        runs = [*base, (self._write(rows, batch_id), 0)]
        level = 0
        while sum(at == level for _, at in runs) >= FAN:
            merged = self._write(self.merge(self._read([run for run in runs if run[1] == level])), batch_id)
            runs = [*[run for run in runs if run[1] != level], (merged, level + 1)]
            level += 1
        self.folder.put(json.dumps(runs), "manifest", f"{batch_id:012d}.json", overwrite=True)
        kept = {name for name, _ in [*base, *runs]}
        for name in self.folder.names():
            if name.startswith("run=") and name.removeprefix("run=") not in kept:
                self.folder.drop(name)
        if batch_id >= 1:
            self.folder.drop("manifest", f"{batch_id - 2:012d}.json")
