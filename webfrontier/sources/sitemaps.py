"""Sitemap documents: parsing, following index files, age filter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webfrontier.model import SITEMAP_XML
from webfrontier.operators.skew import heavy_keys, spread_join
from webfrontier.operators.unnest import unnest
from webfrontier.session import cut_and_count, cut_lineage

# The only lastmod format that counts (fixed value); its Z is read as UTC.
LASTMOD_FORMAT = "yyyy-MM-dd'T'HH:mm'Z'"


def _entry(kind: str, loc: Column, lastmod: Column) -> Column:
    # A missing address counts as an empty one.
    address = F.coalesce(loc, F.lit("")).alias("loc")
    return F.struct(F.lit(kind).alias("kind"), address, lastmod.alias("lastmod"))


def _documents(sitemaps: DataFrame) -> DataFrame:
    """``(sitemap_url, entries)``, one row per document; a document may hold both kinds of entries."""
    tree = F.from_xml("xml", SITEMAP_XML, {"ignoreSurroundingSpaces": "false"})
    none = F.lit(None).cast("string")
    children = F.transform("tree.sitemap", lambda s: _entry("sitemap", s["loc"], none))
    pages = F.transform("tree.url", lambda u: _entry("page", u["loc"], u["lastmod"]))
    return sitemaps.select(F.col("url").alias("sitemap_url"), tree.alias("tree")).select(
        "sitemap_url",
        F.concat(F.coalesce(children, F.array()), F.coalesce(pages, F.array())).alias("entries"),
    )


def sitemaps_from_responses(responses: DataFrame) -> DataFrame:
    """``(url, xml)``, one row per URL, of responses ``(url, code, body)`` with code 200 that hold a list or an index of URLs.

    The body of another answer is no sitemap, whatever it says. Of several bodies of one URL the first by text is taken.
    """
    listing = F.contains("body", F.lit("<urlset")) | F.contains("body", F.lit("<sitemapindex"))
    found = responses.where((F.col("code") == 200) & listing)
    return found.groupBy("url").agg(F.min("body").alias("xml"))


def parse_sitemaps(sitemaps: DataFrame) -> DataFrame:
    """``(url, xml)`` documents to ``(sitemap_url, kind, loc, lastmod)``; kind is ``page`` or ``sitemap``."""
    return unnest(_documents(sitemaps), ["sitemap_url"], F.col("entries"))


def root_sitemaps(sites: DataFrame) -> DataFrame:
    """``(tag, sitemap_url)`` of the sites that use their sitemap."""
    root = F.concat("scheme", F.lit("://"), "domain", F.lit("/sitemap.xml"))
    return sites.where(~F.col("ignoreSitemap")).select("tag", root.alias("sitemap_url"))


def resolve_sitemaps(roots: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """Follows index files from ``(tag, sitemap_url)`` rows; ``(tag, sitemap_url, depth, loc, lastmod)``.

    ``sitemaps`` has one row per URL. Repeated entries stay repeated, and an entry comes once for every way that leads to
    its document. A document is not entered again below itself, so the walk ends.
    """
    rows = walk_sitemaps(roots, sitemaps)
    times = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("ways")))
    return rows.select("*", times.alias("_time")).drop("ways", "_time")


def walk_sitemaps(roots: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """``(tag, sitemap_url, depth, loc, lastmod, ways)``: the entries of ``resolve_sitemaps``, with the number of ways that lead
    to them by each set of documents that matters.

    Ways to a document are counted, not listed, so a level has one open row per tag and document. Only documents that may lie on
    a cycle are kept in mind behind a way: no other can be met again. Each level is one join on the document's URL.
    """
    documents = cut_lineage(_documents(sitemaps))
    on_cycles = _on_cycles(documents)
    start = roots.groupBy("tag", "sitemap_url").agg(F.count(F.lit(1)).alias("ways"))
    open_rows = _with_trail(start, F.array().cast("array<string>"), on_cycles)
    found: list[DataFrame] = []
    to_open = None
    deeper = (F.col("kind") == "sitemap") & ~F.array_contains("trail", F.col("loc"))
    while True:
        heavy = heavy_keys(open_rows, ["sitemap_url"], at_most=to_open)
        reached, to_open = cut_and_count(
            unnest(
                spread_join(open_rows, documents, ["sitemap_url"], "inner", ["tag"], heavy),
                ["tag", "sitemap_url", "trail", "ways"],
                F.col("entries"),
            ),
            deeper,
        )
        found.append(
            reached.where(F.col("kind") == "page").select(
                "tag", "sitemap_url", F.lit(len(found)).alias("depth"), "loc", "lastmod", "ways"
            )
        )
        if not to_open:
            return reduce(DataFrame.unionByName, found)
        children = reached.where(deeper).select("tag", F.col("loc").alias("sitemap_url"), "trail", "ways")
        children = children.groupBy("tag", "sitemap_url", "trail").agg(F.sum("ways").alias("ways"))
        open_rows = _with_trail(children, F.col("trail"), on_cycles)


def _on_cycles(documents: DataFrame) -> DataFrame | None:
    """``(sitemap_url)`` of documents that may lie on a cycle of index files, or None when there is no cycle.

    References from documents that nothing refers to, and to documents that refer to nothing, lie on no cycle. They are taken
    away until none of them is left; a tree of depth d takes about d / 2 rounds over its references.
    """
    children = F.filter("entries", lambda entry: entry["kind"] == "sitemap")
    edges = unnest(documents, ["sitemap_url"], children).select(F.col("sitemap_url").alias("src"), F.col("loc").alias("dst"))
    edges, left = cut_and_count(edges.distinct())
    while left:
        sources = edges.select(F.col("src").alias("dst")).distinct()
        targets = edges.select(F.col("dst").alias("src")).distinct()
        kept, after = cut_and_count(edges.join(sources, "dst", "left_semi").join(targets, "src", "left_semi"))
        if after >= left:
            return cut_lineage(edges.select(F.col("src").alias("sitemap_url")).distinct())
        edges, left = kept, after
    return None


def _with_trail(rows: DataFrame, trail: Column, on_cycles: DataFrame | None) -> DataFrame:
    """The rows with the documents that the way must not enter again, in order, so that equal sets are equal arrays."""
    if on_cycles is None:
        return rows.withColumn("trail", F.array().cast("array<string>"))
    marked = rows.withColumn("trail", trail).join(on_cycles.withColumn("_cyclic", F.lit(True)), "sitemap_url", "left")
    longer = F.array_sort(F.array_union("trail", F.array("sitemap_url")))
    none = F.array().cast("array<string>")
    return marked.withColumn("trail", F.when(F.col("_cyclic"), longer).otherwise(none)).drop("_cyclic")


def recent_urls(sitemap_urls: DataFrame, sites: DataFrame, now: str) -> DataFrame:
    """Keeps entries younger than the site's ``maxAge`` seconds; a negative age keeps all.

    The age counts only for the site's own sitemap (depth 0), not for child documents.
    """
    written = F.try_to_timestamp("lastmod", F.lit(LASTMOD_FORMAT))
    age = F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp(written)
    joined = spread_join(sitemap_urls, sites.select("tag", "maxAge"), ["tag"], "inner", ["loc"])
    return joined.where(
        (F.col("maxAge") < 0) | (F.col("depth") > 0) | (age < F.col("maxAge"))
    ).drop("maxAge")
