"""A whole run over stored responses: sites, sitemaps, robots files and pages in, frontier out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webfrontier.operators.discovery import discover
from webfrontier.operators.links import allowed_links, extract_links, site_policy
from webfrontier.operators.seeds import frontier_row, seed_urls
from webfrontier.operators.skew import heavy_keys, spread_join
from webfrontier.session import cut_lineage
from webfrontier.sources.robots import ANY_AGENT, robots_from_responses
from webfrontier.sources.sitemaps import recent_urls, resolve_sitemaps, root_sitemaps, sitemaps_from_responses


def crawl(
    responses: DataFrame,
    sites: DataFrame,
    robots: DataFrame | None,
    sitemaps: DataFrame | None,
    now: str,
    agent: str = ANY_AGENT,
    roots: DataFrame | None = None,
) -> DataFrame:
    """Frontier rows, with their depth, of all URLs the sites lead to.

    ``responses`` is ``(tag, url, code, headers, body)``. URLs without a response stay "new": they are
    what a fetcher has to get next. ``roots`` replaces the sites' default sitemap addresses. Robots files
    and sitemaps that are not given are those among the responses that came with code 200.
    """
    sites = cut_lineage(sites)
    if robots is None:
        robots = robots_from_responses(responses, sites)
    if sitemaps is None:
        sitemaps = sitemaps_from_responses(responses)
    if roots is None:
        roots = root_sitemaps(sites)
    listed = recent_urls(resolve_sitemaps(roots, sitemaps), sites, now)
    seeds = cut_lineage(seed_urls(sites, listed, now))
    heavy = heavy_keys(responses, ["tag"])
    links = extract_links(responses, keep=["tag"])
    followed = allowed_links(links, site_policy(sites, robots, agent), heavy)
    found = discover(
        seeds,
        followed.select("tag", F.col("page").alias("src"), F.col("link").alias("dst")),
        caps=sites,
        answered=responses.select("tag", F.col("url").alias("key")),
    )
    labels = seeds.groupBy("tag", "key").agg(F.min("searchable").alias("_label"))
    labelled = found.join(labels, ["tag", "key"], "left")
    rows = spread_join(labelled, sites.select("tag", "data"), ["tag"], "left", ["key"], heavy)
    tag, key = F.col("tag"), F.col("key")
    label = F.coalesce(
        "_label", F.concat(F.lit("Discovered "), key, F.lit(" from "), F.col("parent"))
    )
    state = F.col("flag").alias("_flag")
    columns = frontier_row(key, tag, label, F.col("data"), now)
    return rows.select(*columns, state, "depth").withColumn("flag", F.col("_flag")).drop("_flag")
