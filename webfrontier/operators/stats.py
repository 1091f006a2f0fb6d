"""Counts per run, progress, and the run report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webfrontier.model import DONE, NEW, PROCESSING


def crawl_stats(frontier: DataFrame) -> DataFrame:
    """``(tag, done, processing, new, total)`` of every tag in one pass; signatures don't count."""
    flag = F.col("flag")
    return frontier.groupBy("tag").agg(
        F.count_if(flag == DONE).alias("done"),
        F.count_if(flag == PROCESSING).alias("processing"),
        F.count_if(flag == NEW).alias("new"),
        F.count_if(flag.isin(DONE, PROCESSING, NEW)).alias("total"),
    )


def crawl_progress(stats: DataFrame) -> DataFrame:
    """Adds the finished share in percent; 0 when nothing is finished."""
    share = F.try_divide(F.col("done") * 100.0, F.col("total"))
    return stats.withColumn("progress", F.coalesce(F.round(share, 2), F.lit(0.0)))


def crawl_report(crawls: DataFrame, stats: DataFrame) -> DataFrame:
    """One row per run: its settings in display form and its counts. Both sides have one row per tag."""
    counts = crawl_progress(stats)
    number = ["done", "processing", "new", "total", "progress"]
    joined = crawls.join(counts, "tag", "left").fillna(0, number)
    return joined.select(
        "tag",
        "label",
        F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"),
        "domain",
        "scheme",
        F.array_join("authorizedDomains", ", ").alias("authorized_domains"),
        F.when(F.col("maxPages") > -1, F.col("maxPages").cast("string"))
        .otherwise("Unlimited")
        .alias("max_pages"),
        "callback",
        F.col("callbackUrl").alias("callback_url"),
        F.col("datasourceId").alias("datasource_id"),
        (~F.col("noDiscovery")).alias("discovery"),
        (~F.col("ignoreSitemap")).alias("sitemap"),
        *number,
    )
