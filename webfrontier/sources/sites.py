"""Settings of the sites to work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webfrontier.functions.binding import let
from webfrontier.functions.urls import strip_blanks
from webfrontier.model import SITE


def crawl_tag(domain: Column, prefix: str) -> Column:
    """Name shared by all rows of one run over a site (fixed format)."""
    return F.concat_ws("_", F.lit("crawling"), domain, F.lit(prefix))


def read_site_configs(spark: SparkSession, path: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    """One JSON document per line; returns the accepted sites and the rejected lines."""
    return site_configs(spark.read.text(path).withColumnRenamed("value", "config"), prefix)


def site_configs(configs: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """``config`` JSON text to one typed row per site; and what is rejected, with a reason."""
    parsed = configs.withColumn("_site", F.from_json("config", SITE))
    complete = F.coalesce(
        F.col("_site.domain").isNotNull() & F.col("_site.scheme").isNotNull(), F.lit(False)
    )
    site = F.col("_site")
    accepted = parsed.where(complete).select(
        crawl_tag(site["domain"], prefix).alias("tag"),
        site["domain"].alias("domain"),
        site["scheme"].alias("scheme"),
        let(site["authorizedDomains"], _domain_list).alias("authorizedDomains"),
        F.coalesce(site["maxPages"].try_cast("int"), F.lit(-1)).alias("maxPages"),
        site["callback"].alias("callback"),
        _is_set(site["noDiscovery"]).alias("noDiscovery"),
        _is_set(site["ignoreSitemap"]).alias("ignoreSitemap"),
        F.coalesce(site["maxAge"].try_cast("bigint"), F.lit(-1)).alias("maxAge"),
        site["datasourceId"].alias("datasourceId"),
        site["callbackUrl"].alias("callbackUrl"),
        F.col("config").alias("data"),
    )
    rejected = parsed.where(~complete).select(
        "config", F.lit("domain and scheme are required").alias("reason")
    )
    # Settings of one domain would share a tag, and with it their rows: the first by text is kept.
    order = F.row_number().over(Window.partitionBy("tag").orderBy("data"))
    placed = accepted.withColumn("_place", order)
    repeated = placed.where(F.col("_place") > 1).select(
        F.col("data").alias("config"), F.lit("the domain has other settings in this run").alias("reason")
    )
    return placed.where(F.col("_place") == 1).drop("_place"), rejected.unionByName(repeated)


def _is_set(value: Column) -> Column:
    return F.coalesce(~value.isin("", "0", "false"), F.lit(False))


def _domain_list(text: Column) -> Column:
    """A JSON list, or names separated by commas."""
    listed = F.from_json(text, "array<string>")
    commas = F.transform(F.split(text, ","), strip_blanks)
    return F.coalesce(
        F.when(F.startswith(text, F.lit("[")), listed).when(text != "", commas), F.array()
    )
