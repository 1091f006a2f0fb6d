"""Page responses as tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webfrontier.functions.http import body_text, header_map
from webfrontier.model import RESPONSES


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESPONSES).parquet(path)


def stream_responses(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(RESPONSES).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


def pages_to_responses(pages: DataFrame) -> DataFrame:
    """Stored pages are successful HTML responses."""
    return pages.select(
        "url",
        F.lit(200).alias("code"),
        F.create_map(F.lit("content-type"), F.lit("text/html")).alias("headers"),
        F.col("html").alias("body"),
    )


def parse_raw_responses(raw: DataFrame) -> DataFrame:
    """``raw_headers`` text and ``raw_body`` bytes become a header map and a text body."""
    headed = raw.withColumn("headers", header_map(F.col("raw_headers")))
    content_type = F.col("headers")["content-type"]
    return headed.withColumn("body", body_text(F.col("raw_body"), content_type)).drop(
        "raw_headers", "raw_body"
    )


def mark_crawlable(responses: DataFrame) -> DataFrame:
    """Adds ``crawlable``: code 200 and a content type that contains ``text/html``.

    Other responses stay in the table, since they are finished pages too.
    """
    html = F.contains(F.col("headers")["content-type"], F.lit("text/html"))
    return responses.withColumn(
        "crawlable", F.coalesce((F.col("code") == 200) & html, F.lit(False))
    )
