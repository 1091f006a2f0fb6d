"""Inputs derived from the driver's tables by fixed formulas, so that every rule is reached.

Each formula runs over whole tables on Spark; ``oracle`` states the same formulas in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webfrontier.functions.urls import url_domain, url_scheme
from webfrontier.operators.links import extract_links
from webfrontier.sources.responses import pages_to_responses
from webfrontier.sources.sites import crawl_tag, site_configs

PREFIX = "t1"
NOW = "2024-01-20 00:00:00"
CRAWL_TIME = "2024-01-20T00:00:00"

# One of these is appended to each page as an anchor; www.ex.com stands for the page's own host.
HREFS = [
    "/a/b/",
    "//www.ex.com/a",
    "//cdn.net/x.js",
    "#top",
    "/a#b",
    "mailto:a@b.c",
    "mailto:a@b.c#x",
    "../up",
    "./x",
    "https://www.ex.com",
    "https://www.ex.com.evil.org/",
    "HTTPS://WWW.EX.COM/a",
    "http://www.ex.com/a",
    "https://other.org//",
    "MAILTO:a@b.c",
    "javascript:void(0)",
    "tel:+33",
    "?page=2",
    "",
    "page.html",
    "httpdocs/x",
    " /a",
]

ENTITY_TEXT = (
    "<p>caf&eacute; &#65;&#x42; &amp;lt; a&nbsp;b l&rsquo;x &lt;b&gt; &zz; &#39;<!-- c --></p>"
)

ROBOTS_BODY = (
    "# rules of the site\n"
    "User-agent: other\n"
    "Disallow: /\n"
    "\n"
    "User-Agent: *\n"
    "User-agent: zed\n"
    "Disallow: /en  # a section\n"
    "Allow: /en/1\n"
    "Disallow: /*.html$\n"
    "disallow: /*/9*5\n"
)
ROBOTS_EMPTY = "User-agent: *\nDisallow:\n"

# Pages per sitemap document.
CHUNK = 500

FLAGS = {"signup": 2, "view": 1, "click": 1, "purchase": 0, "error": -1}

MONTH_WORDS = [
    "janvier",
    "février",
    "mars",
    "avril",
    "mai",
    "juin",
    "juillet",
    "août",
    "septembre",
    "octobre",
    "novembre",
    "décembre",
    "brumaire",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], number: Column) -> Column:
    return F.array(*[F.lit(v) for v in values])[F.pmod(number, F.lit(len(values))).cast("int")]


def content_type(page_id: Column) -> Column:
    return (
        F.when(page_id % 7 == 0, F.lit("application/pdf"))
        .when(page_id % 7 == 1, F.lit("text/html; charset=iso-8859-1"))
        .otherwise(F.lit("text/html; charset=utf-8"))
    )


def responses(pages: DataFrame) -> DataFrame:
    """``(page_id, tag, url, code, headers, body)``; also works on a stream of pages."""
    number = F.col("page_id")
    host = url_domain(F.col("url"))
    href = F.replace(_pick(HREFS, number), F.lit("www.ex.com"), host)
    anchor = F.concat(F.lit('<a href="'), href, F.lit('">m</a>'))
    return pages.select(
        "page_id",
        crawl_tag(host, PREFIX).alias("tag"),
        "url",
        F.when(number % 10 == 0, F.lit(404)).otherwise(F.lit(200)).alias("code"),
        F.create_map(F.lit("content-type"), content_type(number)).alias("headers"),
        F.concat("html", anchor).alias("body"),
    )


def with_entities(pages: DataFrame) -> DataFrame:
    """Pages with more kinds of character references at the start of the article."""
    start = F.lit("<article>")
    html = F.replace(F.col("html"), start, F.concat(start, F.lit(ENTITY_TEXT)))
    return pages.withColumn("html", html)


def hosts(pages: DataFrame) -> DataFrame:
    url = F.col("url")
    return pages.groupBy(url_domain(url).alias("host")).agg(
        F.min("page_id").alias("first_id"), F.min(url_scheme(url)).alias("scheme")
    )


def config_texts(pages: DataFrame) -> DataFrame:
    """``config``: one JSON settings text per host."""
    n = F.col("first_id")

    def field(when: Column, *text) -> Column:
        parts = [t if isinstance(t, Column) else F.lit(t) for t in text]
        return F.when(when, F.concat(*parts)).otherwise(F.lit(""))

    config = F.concat(
        F.lit('{"scheme":"'),
        F.col("scheme"),
        F.lit('"'),
        field(n % 11 != 0, ',"domain":"', F.col("host"), '"'),
        field(n % 2 == 0, ',"authorizedDomains":["cdn.net","other.org"]'),
        field((n % 2 == 1) & (n % 3 == 0), ',"authorizedDomains":"cdn.net , other.org"'),
        field(n % 3 == 0, ',"maxPages":', (n % 20).cast("string")),
        field(n % 5 == 0, ',"noDiscovery":true'),
        field(n % 4 == 0, ',"ignoreSitemap":true'),
        field(n % 3 == 1, ',"maxAge":259200'),
        field(n % 3 == 2, ',"maxAge":864000'),
        field(n % 6 == 0, ',"datasourceId":""'),
        field(n % 6 != 0, ',"datasourceId":"ds ', n.cast("string"), '"'),
        field(n % 2 == 0, ',"callbackUrl":"http://sink.example/', F.col("host"), '"'),
        field(n % 4 == 0, ',"callback":"search"'),
        field(n % 4 == 2, ',"callback":"other"'),
        F.lit("}"),
    )
    return hosts(pages).select(config.alias("config"))


def sites(pages: DataFrame) -> DataFrame:
    return site_configs(config_texts(pages), PREFIX)[0]


def robots(pages: DataFrame) -> DataFrame:
    """``(tag, host, body)``; a third of the hosts has no robots file."""
    n = F.col("first_id")
    body = F.when(n % 3 == 0, F.lit(ROBOTS_BODY)).when(n % 3 == 1, F.lit(ROBOTS_EMPTY))
    rows = hosts(pages).select(crawl_tag(F.col("host"), PREFIX).alias("tag"), "host", body.alias("body"))
    return rows.where(F.col("body").isNotNull())


def robots_responses(pages: DataFrame) -> DataFrame:
    """``(tag, url, code, body)``: an answer of every host for its robots file; a third of them, with rules too, has code 404."""
    n, host = F.col("first_id"), F.col("host")
    found = n % 3 != 2
    return hosts(pages).select(
        crawl_tag(host, PREFIX).alias("tag"),
        F.concat("scheme", F.lit("://"), host, F.lit("/robots.txt")).alias("url"),
        F.when(found, F.lit(200)).otherwise(F.lit(404)).alias("code"),
        F.when(n % 3 == 1, F.lit(ROBOTS_EMPTY)).otherwise(F.lit(ROBOTS_BODY)).alias("body"),
    )


def sitemap_responses(pages: DataFrame) -> DataFrame:
    """``(tag, url, code, body)``: the sitemaps as answers; all of some hosts, and the child documents of others, have code 404."""
    host = url_domain(F.col("url"))
    child = F.contains("url", F.lit("/urls-"))
    missing = (F.length(host) % 3 == 0) | (child & (F.length(host) % 4 == 0))
    return sitemaps(pages).select(
        crawl_tag(host, PREFIX).alias("tag"),
        "url",
        F.when(missing, F.lit(404)).otherwise(F.lit(200)).alias("code"),
        F.col("xml").alias("body"),
    )


def _chunks(pages: DataFrame) -> DataFrame:
    """Pages of one host in groups of at most ``CHUNK``, as the text of their sitemap entries."""
    number = F.col("page_id")
    lastmod = F.when(
        number % 5 != 0,
        F.date_format(
            F.timestamp_seconds(F.lit(1704067200) + number * 3600), "yyyy-MM-dd'T'HH:mm'Z'"
        ),
    )
    entry = F.concat(
        F.lit("<url><loc>"),
        F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")),
        F.lit("</loc>"),
        F.coalesce(F.concat(F.lit("<lastmod>"), lastmod, F.lit("</lastmod>")), F.lit("")),
        F.lit("</url>"),
    )
    return (
        pages.select(
            url_domain(F.col("url")).alias("host"),
            F.floor(number / CHUNK).cast("bigint").alias("chunk"),
            "page_id",
            entry.alias("entry"),
        )
        .groupBy("host", "chunk")
        .agg(
            F.min("page_id").alias("low"),
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("page_id", "entry"))), lambda e: e["entry"]
                ),
                "",
            ).alias("entries"),
        )
        .withColumn("base", F.concat(F.lit("http://"), "host", F.lit("/")))
        .withColumn("name", F.concat(F.col("chunk").cast("string"), F.lit(".xml")))
    )


_OPEN = '<?xml version="1.0"?>'
_NS = ' xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def sitemaps(pages: DataFrame) -> DataFrame:
    """``(url, xml)``: per host and chunk a URL list, or an index file with the list and itself."""
    chunks = _chunks(pages)
    root = F.concat("base", F.lit("sitemap-"), "name")
    child = F.concat("base", F.lit("urls-"), "name")
    nested = F.col("low") % 2 == 0
    listing = F.concat(
        F.lit(f"{_OPEN}<urlset{_NS}>"), F.col("entries"), F.lit("</urlset>")
    )
    index = F.concat(
        F.lit(f"{_OPEN}<sitemapindex{_NS}><sitemap><loc>"),
        child,
        F.lit("</loc></sitemap><sitemap><loc>"),
        root,
        F.lit("</loc></sitemap></sitemapindex>"),
    )
    documents = F.array(
        F.struct(F.when(nested, child).otherwise(root).alias("url"), listing.alias("xml")),
        F.struct(F.when(nested, root).alias("url"), index.alias("xml")),
    )
    return chunks.select(F.inline(documents)).where(F.col("url").isNotNull())


def sitemap_roots(pages: DataFrame, site_rows: DataFrame) -> DataFrame:
    roots = _chunks(pages).select(
        crawl_tag(F.col("host"), PREFIX).alias("tag"),
        F.concat("base", F.lit("sitemap-"), "name").alias("sitemap_url"),
    )
    return roots.join(site_rows.where(~F.col("ignoreSitemap")).select("tag"), "tag", "left_semi")


def _address() -> Column:
    """The URL of a page as links name it: without its fragment and the slash at its end."""
    return F.rtrim(F.split_part(F.col("url"), F.lit("#"), F.lit(1)), F.lit("/"))


def linked_pages(pages: DataFrame) -> DataFrame:
    """``(url, code, headers, body)``: pages with links to two other pages behind their own ones."""
    n = pages.agg(F.count(F.lit(1))).scalar()
    number = F.col("page_id")
    rows = pages.select(
        _address().alias("url"), "html", ((number * 7 + 3) % n).alias("_one"), ((number * 5 + 1) % n).alias("_two")
    )
    for name in ("_one", "_two"):
        rows = rows.join(pages.select(number.alias(name), _address().alias(f"{name}_url")), name)

    def anchor(name: str) -> Column:
        return F.concat(F.lit('<a href="'), F.replace(F.col(f"{name}_url"), F.lit("&"), F.lit("&amp;")), F.lit('">n</a>'))

    return pages_to_responses(rows.select("url", F.concat("html", anchor("_one"), anchor("_two")).alias("html")))


def edges(pages: DataFrame) -> DataFrame:
    """``(tag, src, dst)``: the links in the pages, for two runs over the same pages."""
    runs = F.array(F.lit("s0"), F.lit("s1"))
    found = extract_links(linked_pages(pages))
    return found.select(F.explode(runs).alias("tag"), F.col("page").alias("src"), F.col("link").alias("dst"))


def edge_seeds(pages: DataFrame) -> DataFrame:
    """The first page for one run, the last one for the other."""
    ends = F.array(
        F.struct(F.lit("s0").alias("tag"), F.min_by(_address(), "page_id").alias("key")),
        F.struct(F.lit("s1").alias("tag"), F.max_by(_address(), "page_id").alias("key")),
    )
    return pages.agg(ends.alias("ends")).select(F.inline("ends"))


def edge_caps(pages: DataFrame) -> DataFrame:
    """The first run may see two fifths of the pages; the second has no cap."""
    two_fifths = F.floor(F.count(F.lit(1)) * 2 / 5).cast("int")
    caps = F.array(
        F.struct(F.lit("s0").alias("tag"), two_fifths.alias("maxPages")),
        F.struct(F.lit("s1").alias("tag"), F.lit(-1).alias("maxPages")),
    )
    return pages.agg(caps.alias("caps")).select(F.inline("caps"))


def frontier_events(events: DataFrame) -> DataFrame:
    """Row versions of one frontier row per user; also works on a stream of events."""
    key = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    tag = F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string"))
    flags = F.create_map(*[F.lit(x) for pair in FLAGS.items() for x in pair])
    moment = F.col("ts").cast("timestamp")
    return events.select(
        key.alias("id"),
        F.lit("webfrontier.discovery").alias("class"),
        F.date_trunc("second", moment).alias("datetime"),
        key.alias("key"),
        F.concat(tag, F.lit(".example.org")).alias("domain"),
        tag.alias("tag"),
        flags[F.col("event_type")].alias("flag"),
        F.concat(
            F.lit("Discovered "), key, F.lit(" from Page-"), F.col("event_type")
        ).alias("searchable"),
        F.col("props").alias("data"),
        moment.alias("event_time"),
        F.col("event_id").alias("event_no"),
        F.lit(False).alias("deleted"),
    )
