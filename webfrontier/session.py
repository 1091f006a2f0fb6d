"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "webfrontier", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster passes its own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session without one gets a fresh folder."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if configured is None and current is None and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if current is None:
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="webfrontier-"))
        current = context.getCheckpointDir()
    return configured or current


def cut_lineage(rows: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and keeps later plans short."""
    checkpoint_root(rows.sparkSession)
    return rows.checkpoint(eager=True)


def cut_and_count(rows: DataFrame, condition: Column | None = None) -> tuple[DataFrame, int]:
    """Checkpoint, and the number of its rows (that meet a condition) counted while it is written.

    A repeated task may be counted twice, so the number can be too high but is 0 only when there are none.
    """
    seen = Observation()
    counted = F.count(F.lit(1)) if condition is None else F.count_if(condition)
    kept = cut_lineage(rows.observe(seen, counted.alias("rows")))
    return kept, seen.get["rows"]


def scratch_table(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder for a table this job writes and reads back."""
    return f"{checkpoint_root(spark).rstrip('/')}/webfrontier/{name}-{uuid.uuid4().hex}"
