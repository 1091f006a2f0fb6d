"""Links of pages, and the rules that decide which of them may be followed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webfrontier.functions.html import page_link_array
from webfrontier.functions.urls import url_domain, url_path, url_scheme
from webfrontier.operators.skew import MEASURE, spread_join
from webfrontier.operators.unnest import unnest
from webfrontier.sources.responses import mark_crawlable
from webfrontier.sources.robots import ANY_AGENT, robots_allow, robots_policy


def page_links(responses: DataFrame) -> DataFrame:
    """Adds ``links``: the distinct ``struct(link, link_type)`` of each crawlable page, in page order.

    Narrow: no shuffle, and the page body goes no further than its own task.
    """
    url = F.col("url")
    links = page_link_array(F.col("body"), url_domain(url), url_scheme(url))
    return mark_crawlable(responses).withColumn("links", F.when(F.col("crawlable"), links))


def extract_links(responses: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``(*keep, page, link_type, link)``; each link once per page and type."""
    keep = [*(keep or []), "page"]
    linked = unnest(page_links(responses.withColumn("page", F.col("url"))), keep, F.col("links"))
    return linked.select(*keep, "link_type", "link")


def site_policy(sites: DataFrame, robots: DataFrame, agent: str = ANY_AGENT) -> DataFrame:
    """One row per tag with all that decides about its links, and the settings text of the run."""
    return sites.select("tag", "noDiscovery", "authorizedDomains", "data").join(
        robots_policy(robots, agent), "tag", "left"
    )


def allowed_by_robots(
    links: DataFrame,
    robots: DataFrame,
    agent: str = ANY_AGENT,
    scope: str = "tag",
    heavy: DataFrame | None | str = MEASURE,
) -> DataFrame:
    """Internal links the robots rules allow.

    ``scope='tag'`` tests every link of a run against the robots file of its start site;
    ``scope='host'`` against the file of the link's own host (``robots`` keyed by ``host``).
    """
    internal = links.where(F.col("link_type") == "internal")
    spread = [c for c in links.columns if c in ("page", "link")]
    if scope == "host":
        # Several runs may have fetched the file of one host; one of them is enough.
        files = robots.groupBy(F.col("host").alias("tag")).agg(F.min("body").alias("body"))
        rules = robots_policy(files, agent).withColumnRenamed("tag", "_host")
        keyed = internal.withColumn("_host", url_domain(F.col("link")))
        if isinstance(heavy, DataFrame) and "_host" not in heavy.columns:
            heavy = MEASURE
        joined = spread_join(keyed, rules, ["_host"], "left", spread, heavy)
    else:
        joined = spread_join(internal, robots_policy(robots, agent), ["tag"], "left", spread, heavy)
    return joined.where(robots_allow(url_path(F.col("link")), F.col("robots_rules"))).select(
        *links.columns
    )


def in_allowed_domains(
    links: DataFrame, sites: DataFrame, heavy: DataFrame | None | str = MEASURE
) -> DataFrame:
    """External links whose domain is one of the site's authorised domains."""
    external = links.where(F.col("link_type") == "external").withColumn(
        "_domain", url_domain(F.col("link"))
    )
    domains = sites.select("tag", F.explode(F.array_distinct("authorizedDomains")).alias("_domain"))
    return spread_join(
        external, domains, ["tag", "_domain"], "left_semi", ["page", "link"], heavy
    ).select(*links.columns)


def allowed_links(
    links: DataFrame, policy: DataFrame, heavy: DataFrame | None | str = MEASURE
) -> DataFrame:
    """Links to follow: discovery is on, and robots rules (internal) or domain list (external) agree.

    One join on the tag serves all three tests.
    """
    joined = spread_join(links, policy, ["tag"], "inner", ["page", "link"], heavy)
    return joined.where(may_follow(F.col("link"), F.col("link_type"))).select(*links.columns)


def may_follow(link: Column, link_type: Column) -> Column:
    """The rules of a row of ``site_policy`` applied to a link."""
    robots_ok = robots_allow(url_path(link), F.col("robots_rules"))
    domain_ok = F.array_contains("authorizedDomains", url_domain(link))
    return ~F.col("noDiscovery") & F.when(link_type == "internal", robots_ok).otherwise(domain_ok)
