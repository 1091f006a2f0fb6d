"""Small helpers that the corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webfrontier.session import scratch_table

PACKAGE = Path(__file__).resolve().parent.parent
#: Stands for a missing doc_id while rows travel: it orders before every other id and comes out as null again.
NO_ID = -(2**63)
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Makes the session ready for Python workers: they get this package, and texts in batches of few rows.

    Texts are long, and both sides of the Arrow exchange hold a batch, and more while its buffers grow.
    """
    if int(spark.conf.get(_BATCH_ROWS)) > BATCH_ROWS:
        spark.conf.set(_BATCH_ROWS, BATCH_ROWS)
    context = spark.sparkContext
    if getattr(context, "_webfrontier_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="webfrontier-code-")) / "webfrontier_code.zip"
    with zipfile.ZipFile(path, "w") as bundle:
        for file in sorted(PACKAGE.rglob("*.py")):
            bundle.write(file, file.relative_to(PACKAGE.parent))
    context.addPyFile(str(path))
    context._webfrontier_shipped = True


def id_column(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def id_back(name: str = "doc_id") -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name)).alias("doc_id")


def free_name(rows: DataFrame, name: str) -> str:
    """A column name that the rows don't have."""
    while name in rows.columns:
        name += "_"
    return name


def whole_text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: later plans read it, and lost executors cost no recomputation."""
    path = scratch_table(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def settled(rows: DataFrame, name: str) -> DataFrame:
    """``written``, after which the shuffle files of the jobs before are let go.

    Spark removes them when the driver collects its garbage, which a driver with little to do may put off for long.
    """
    table = written(rows, name)
    gc.collect()
    rows.sparkSession.sparkContext._jvm.System.gc()
    return table


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts of the columns doc_id and text, in small groups, so that Python holds few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


def map_texts(docs: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow over the columns doc_id and text of all rows, other columns are not read."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(function, schema)
