"""First frontier rows of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webfrontier.functions.urls import url_domain
from webfrontier.model import FRONTIER, NEW, SIGNATURE
from webfrontier.operators.frontier import row_id
from webfrontier.operators.skew import spread_join

ROW_CLASS = "webfrontier.discovery"

# The label texts of frontier rows below and in discovery are fixed formats.


def frontier_row(
    key: Column, tag: Column, label: Column, data: Column, now: str, flag: int = NEW
) -> list[Column]:
    """The columns of one frontier row."""
    return [
        row_id(tag, key).alias("id"),
        F.lit(ROW_CLASS).alias("class"),
        F.to_timestamp(F.lit(now)).alias("datetime"),
        key.alias("key"),
        url_domain(key).alias("domain"),
        tag.alias("tag"),
        F.lit(flag).alias("flag"),
        label.alias("searchable"),
        data.alias("data"),
    ]


def seed_urls(sites: DataFrame, sitemap_urls: DataFrame, now: str) -> DataFrame:
    """Sitemap URLs of each site, or its homepage when there are none.

    Sitemap URLs are taken as they are: repeated ones stay repeated and no robots rule applies.
    """
    tag, data = F.col("tag"), F.col("data")
    label = F.concat(F.lit("Crawling domain "), F.col("domain"))
    used = sites.where(~F.col("ignoreSitemap")).select("tag", "domain", "data")
    listed = spread_join(sitemap_urls.select("tag", "loc"), used, ["tag"], "inner", ["loc"])
    from_sitemap = listed.select(
        *frontier_row(F.col("loc"), tag, F.concat(label, F.lit(" from sitemap.xml")), data, now)
    )
    homepage = F.concat("scheme", F.lit("://"), "domain")
    # A site that ignores its sitemap has no listed tag, so it is never matched.
    having = sitemap_urls.select(F.col("tag").alias("_listed")).distinct()
    alone = sites.withColumn("_tag", F.when(~F.col("ignoreSitemap"), tag)).join(
        having, F.col("_tag") == F.col("_listed"), "left_anti"
    )
    return from_sitemap.unionByName(alone.select(*frontier_row(homepage, tag, label, data, now)))


def signature_rows(sites: DataFrame, now: str, process: str) -> DataFrame:
    """One row per run that carries its settings."""
    label = F.concat(F.lit("Crawler for domain "), F.col("domain"))
    row = frontier_row(F.lit(process), F.col("tag"), label, F.col("data"), now, SIGNATURE)
    return sites.select(*row).select(*FRONTIER.fieldNames())
