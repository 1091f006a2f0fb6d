"""The registered queries: each takes a session and a folder of tables and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webfrontier.functions import http
from webfrontier.functions.urls import url_domain
from webfrontier.model import DONE, NEW, PROCESSING
from webfrontier.operators import callbacks, discovery, documents, frontier, links, seeds, stats
from webfrontier.operators.skew import heavy_keys
from webfrontier.operators.store import FrontierStore
from webfrontier.plans import derived as D
from webfrontier.plans.crawl import crawl
from webfrontier.session import cut_lineage, scratch_table
from webfrontier.sources import items, responses, robots, sitemaps, sites
from webfrontier.sources.folders import Folder
from webfrontier.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LATER = "2030-01-01 00:00:00"
MOMENT = "yyyy-MM-dd HH:mm:ss"
CONFIG = "domain string, scheme string, maxPages int, datasourceId string"


def query(function: Query) -> Query:
    def in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return function(spark, sf_dir)

    QUERIES[function.__name__] = in_utc
    return in_utc


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "pages")


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.responses(_pages(spark, sf_dir))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.extract_links(_responses(spark, sf_dir), keep=["tag"])


def _heavy_tags(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    # Shares of the tags by pages: reads the url column only.
    return heavy_keys(_responses(spark, sf_dir), ["tag"])


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.sites(_pages(spark, sf_dir))


def _site_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sites as a table, for queries that use them several times."""
    return cut_lineage(_sites(spark, sf_dir))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.frontier_events(D.table(spark, sf_dir, "events"))


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.latest_state(_events(spark, sf_dir))


# --- pages -------------------------------------------------------------------------------------


@query
def responses_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = responses.mark_crawlable(_responses(spark, sf_dir))
    return marked.select("page_id", "url", "code", "crawlable")


@query
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.extract_links(_responses(spark, sf_dir), keep=["page_id"])


@query
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.extract_titles(
        _responses(spark, sf_dir)
    ).select("page_id", "crawlable", "title")


@query
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = D.with_entities(_pages(spark, sf_dir))
    return documents.extract_text(D.responses(pages)).select("page_id", "text")


@query
def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents.page_documents(_responses(spark, sf_dir), D.CRAWL_TIME, keep=["page_id"])
    return docs.select(
        "page_id",
        F.array_join("internal_links", " | ").alias("internal_links"),
        F.array_join("external_links", " | ").alias("external_links"),
        "crawl_time",
        "domain",
        "body",
        "html",
        F.col("headers")["content-type"].alias("content_type"),
        "title",
    )


@query
def pages_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.count_by_domain(_pages(spark, sf_dir))


@query
def pages_by_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.count_by_scheme(_pages(spark, sf_dir))


@query
def query_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.query_params(_pages(spark, sf_dir), "url", keep=["page_id"])


def _raw_headers() -> Column:
    number = F.col("page_id").cast("string")
    return F.concat(
        F.lit("HTTP/1.1 301 Moved\r\nLocation: "),
        "url",
        F.lit("\r\nX-Id: a:"),
        number,
        F.lit("\r\n\r\nHTTP/1.1 200 OK\r\nContent-Type: "),
        D.content_type(F.col("page_id")),
        F.lit("\r\nx-id :  b:"),
        number,
        F.lit(" \r\n\r\n"),
    )


@query
def header_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return pages.select("page_id", F.explode(http.header_map(_raw_headers())).alias("name", "value"))


@query
def charset_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    latin = F.encode(F.regexp_replace("html", r"[^\u0000-ÿ]", "?"), "ISO-8859-1")
    raw = _pages(spark, sf_dir).select(
        "page_id",
        _raw_headers().alias("raw_headers"),
        F.when(F.col("page_id") % 7 == 1, latin)
        .otherwise(F.encode("html", "UTF-8"))
        .alias("raw_body"),
    )
    return responses.parse_raw_responses(raw).select("page_id", "body")


@query
def utf8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode("text", "UTF-8")
    broken = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("C3")), text, F.unhex(F.lit("80"))))
        .when(F.col("doc_id") % 3 == 1, F.substring(text, F.lit(1), F.octet_length(text) - 1))
        .otherwise(text)
    )
    raw = D.table(spark, sf_dir, "documents").select(
        "doc_id", F.lit("Content-Type: text/html").alias("raw_headers"), broken.alias("raw_body")
    )
    return responses.parse_raw_responses(raw).select("doc_id", F.col("body").alias("text"))


# --- text --------------------------------------------------------------------------------------


@query
def lang_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.table(spark, sf_dir, "documents")
    return documents.label_language(docs, "text").select("doc_id", "label")


@query
def lang_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.language_confusion(D.table(spark, sf_dir, "documents"), "text", "lang")


@query
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.word_counts(D.table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def french_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("doc_id")
    months = F.array(*[F.lit(m) for m in D.MONTH_WORDS])
    date = F.concat_ws(
        " ",
        (number % 28 + 1).cast("string"),
        months[(number % len(D.MONTH_WORDS)).cast("int")],
        (number % 50 + 1990).cast("string"),
        "text",
    )
    docs = D.table(spark, sf_dir, "documents").withColumn("dated", date)
    return documents.french_dates(docs, "dated").select("doc_id", "french_date")


# --- sites, sitemaps, robots -------------------------------------------------------------------


@query
def site_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, rejected = sites.site_configs(D.config_texts(_pages(spark, sf_dir)), D.PREFIX)
    return accepted.select(
        "tag",
        "domain",
        "scheme",
        F.array_join("authorizedDomains", ",").alias("authorized_domains"),
        F.col("maxPages").alias("max_pages"),
        F.col("noDiscovery").alias("no_discovery"),
        F.col("ignoreSitemap").alias("ignore_sitemap"),
        F.col("maxAge").alias("max_age"),
        F.col("datasourceId").alias("datasource_id"),
        F.col("callbackUrl").alias("callback_url"),
        F.col("data").alias("config"),
        F.lit(True).alias("accepted"),
    ).unionByName(
        rejected.select("config", F.lit(False).alias("accepted")), allowMissingColumns=True
    )


@query
def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitemaps.parse_sitemaps(D.sitemaps(_pages(spark, sf_dir)))


def _resolved(pages: DataFrame, site_rows: DataFrame) -> DataFrame:
    return sitemaps.resolve_sitemaps(D.sitemap_roots(pages, site_rows), D.sitemaps(pages))


def _recent(pages: DataFrame, site_rows: DataFrame) -> DataFrame:
    return sitemaps.recent_urls(_resolved(pages, site_rows), site_rows, D.NOW)


@query
def sitemap_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(_pages(spark, sf_dir), _sites(spark, sf_dir))


@query
def sitemap_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = _recent(_pages(spark, sf_dir), _site_table(spark, sf_dir))
    return recent.select("tag", "depth", "loc", "lastmod")


@query
def seed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    site_rows = _site_table(spark, sf_dir)
    rows = seeds.seed_urls(site_rows, _recent(_pages(spark, sf_dir), site_rows), D.NOW)
    return rows.select(
        "id",
        F.date_format("datetime", MOMENT).alias("datetime"),
        "key",
        "domain",
        "tag",
        "flag",
        "searchable",
        "data",
    )


@query
def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = robots.parse_robots(D.robots(_pages(spark, sf_dir)))
    return rules.select(
        "tag",
        F.col("block").cast("bigint").alias("block"),
        F.array_join("agents", ",").alias("agents"),
        "kind",
        "pattern",
    )


@query
def robots_from_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules out of the answers with code 200 among all responses of a run."""
    answers = D.robots_responses(_pages(spark, sf_dir))
    answers = answers.unionByName(_responses(spark, sf_dir).select(*answers.columns))
    rules = robots.parse_robots(robots.robots_from_responses(answers, _sites(spark, sf_dir)))
    return rules.select("tag", F.col("block").cast("bigint").alias("block"), "kind", "pattern")


@query
def sitemaps_from_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed URLs out of the answers with code 200 among all responses of a run."""
    pages = _pages(spark, sf_dir)
    answers = D.sitemap_responses(pages)
    answers = answers.unionByName(_responses(spark, sf_dir).select(*answers.columns))
    roots = D.sitemap_roots(pages, _sites(spark, sf_dir))
    return sitemaps.resolve_sitemaps(roots, sitemaps.sitemaps_from_responses(answers))


@query
def robots_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.allowed_by_robots(
        _links(spark, sf_dir), D.robots(_pages(spark, sf_dir)), heavy=_heavy_tags(spark, sf_dir)
    )


@query
def external_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.in_allowed_domains(
        _links(spark, sf_dir), _sites(spark, sf_dir), _heavy_tags(spark, sf_dir)
    )


# --- frontier ----------------------------------------------------------------------------------


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(
        "id", F.date_format("datetime", MOMENT).alias("datetime"), "key", "tag", "flag", "searchable"
    )


def _stored(spark: SparkSession, sf_dir: str) -> FrontierStore:
    """The events as a stored frontier, written in two appends that hold versions of the same rows."""
    store = FrontierStore(spark, scratch_table(spark, "frontier-store"))
    for part in (0, 1):
        store.append(_events(spark, sf_dir).where(F.pmod("event_no", F.lit(2)) == part))
    return store


@query
def frontier_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _stored(spark, sf_dir)
    store.compact()
    return _shown(store.state())


@query
def frontier_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _events(spark, sf_dir)
    started = frontier.latest_state(log).where(F.col("flag") == NEW)
    moved = frontier.append_events(log, frontier.set_flag(started, PROCESSING, LATER))
    return _shown(frontier.latest_state(moved))


@query
def frontier_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _events(spark, sf_dir)
    finished = frontier.latest_state(log).where(F.col("flag") == DONE)
    gone = frontier.as_events(finished, LATER, deleted=True)
    return _shown(frontier.latest_state(frontier.append_events(log, gone)))


@query
def frontier_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _stored(spark, sf_dir)
    store.drop_tag("t1")
    return _shown(store.state())


@query
def frontier_term_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_stored(spark, sf_dir).lookup(tag="t2", searchable="click"))


@query
def frontier_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_stored(spark, sf_dir).lookup(id="u8"))


@query
def frontier_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(frontier.open_rows(_state(spark, sf_dir)))


@query
def frontier_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.fifo(_state(spark, sf_dir)).select("tag", "key", "position")


@query
def frontier_next_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = frontier.next_batch(_state(spark, sf_dir), 3)
    return batch.select("tag", "key", "position")


@query
def item_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.item_to_json(_state(spark, sf_dir)).select("id", "json")


@query
def item_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    moment = F.col("ts").cast("timestamp")
    written = (
        F.when(
            F.col("event_id") % 3 == 0,
            F.concat(
                F.lit('"datetime":"'), F.date_format(moment, items.ISO_FORMAT), F.lit('",')
            ),
        )
        .when(
            F.col("event_id") % 3 == 1,
            F.concat(
                F.lit('"datetime":{"date":"'),
                F.date_format(moment, items.OBJECT_FORMAT),
                F.lit('","timezone_type":3,"timezone":"UTC"},'),
            ),
        )
        .otherwise(F.lit(""))
    )
    text = F.concat(
        F.lit("{"),
        written,
        F.lit('"key":"u'),
        F.col("user_id").cast("string"),
        F.lit('","flag":2,"other":1,"data":'),
        "props",
        F.lit("}"),
    )
    rows = D.table(spark, sf_dir, "events").select("event_id", text.alias("json"))
    return items.item_from_json(rows, now=D.NOW).select(
        "event_id",
        F.date_format("datetime", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("datetime"),
        "key",
        "domain",
        "flag",
        "data",
    )


# --- runs --------------------------------------------------------------------------------------


def _run_rows(pages: DataFrame, site_rows: DataFrame) -> DataFrame:
    """One frontier row per page, in states that follow the page number, and the signatures."""
    tag = sites.crawl_tag(url_domain(F.col("url")), D.PREFIX)
    row = seeds.frontier_row(F.col("url"), tag, F.lit("page"), F.lit(None).cast("string"), D.NOW)
    rows = pages.select("page_id", *row).withColumn("flag", (F.col("page_id") % 3).cast("int"))
    signatures = seeds.signature_rows(site_rows, D.NOW, "process-1")
    return rows.drop("page_id").unionByName(signatures)


@query
def crawl_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.crawl_stats(frontier.latest_state(_events(spark, sf_dir), keep=["tag", "flag"]))


@query
def crawl_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = frontier.latest_state(_events(spark, sf_dir), keep=["tag", "flag"])
    return stats.crawl_progress(stats.crawl_stats(state))


@query
def active_crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frontier.active_crawls(_run_rows(_pages(spark, sf_dir), _sites(spark, sf_dir)))
    return rows.select(
        "id", "tag", "key", "searchable", F.date_format("datetime", MOMENT).alias("datetime")
    )


@query
def crawl_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frontier.active_crawls(_run_rows(_pages(spark, sf_dir), _sites(spark, sf_dir)))
    return items.decode_data(rows, CONFIG, "config").select(
        "tag",
        "config.domain",
        "config.scheme",
        F.col("config.maxPages").alias("max_pages"),
        F.col("config.datasourceId").alias("datasource_id"),
    )


@query
def crawl_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    site_rows = _site_table(spark, sf_dir)
    rows = _run_rows(_pages(spark, sf_dir), site_rows)
    signatures = frontier.active_crawls(rows).select(
        "tag", F.col("searchable").alias("label"), F.col("datetime").alias("started")
    )
    crawls = site_rows.join(signatures, "tag")
    return stats.crawl_report(crawls, stats.crawl_stats(rows))


@query
def callback_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = callbacks.payload(_responses(spark, sf_dir), _sites(spark, sf_dir), "search")
    return rows.withColumnRenamed("datasourceId", "datasource_id")


@query
def callback_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = callbacks.payload(_responses(spark, sf_dir), _sites(spark, sf_dir), "search")
    return callbacks.with_form_body(rows).select("url", "form")


# --- discovery ---------------------------------------------------------------------------------


@query
def discover_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, site_rows = _pages(spark, sf_dir), _site_table(spark, sf_dir)
    known = seeds.seed_urls(site_rows, _recent(pages, site_rows), D.NOW)
    rows = discovery.discover_round(
        known.unionByName(_run_rows(pages, site_rows)),
        _links(spark, sf_dir),
        links.site_policy(site_rows, D.robots(pages)),
        D.NOW,
        _heavy_tags(spark, sf_dir),
    )
    return rows.select("id", "key", "domain", "tag", "flag", "searchable", "data")


@query
def discover_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    found = discovery.discover(D.edge_seeds(pages), D.edges(pages))
    return found.select("tag", "key", F.col("depth").cast("bigint").alias("depth"), "parent")


@query
def discover_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    found = discovery.discover(D.edge_seeds(pages), D.edges(pages), D.edge_caps(pages))
    return found.select("tag", "key", F.col("depth").cast("bigint").alias("depth"), "flag")


def _run(spark: SparkSession, sf_dir: str, site_rows: DataFrame) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return crawl(
        _responses(spark, sf_dir),
        site_rows,
        D.robots(pages),
        D.sitemaps(pages),
        D.NOW,
        roots=D.sitemap_roots(pages, site_rows),
    )


@query
def crawl_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run, and what is delivered of the pages it processed, to a sink of all sites; responses lie in buckets and are joined
    there."""
    site_rows = _site_table(spark, sf_dir)
    sinks = site_rows.withColumns({"callback": F.lit("search"), "callbackUrl": F.lit("http://sink.example.org")})
    done = _run(spark, sf_dir, site_rows).where(F.col("flag") == DONE)
    path = scratch_table(spark, "responses")
    table = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = callbacks.store_responses(_responses(spark, sf_dir), table, path, buckets)
    rows = callbacks.payload(stored, sinks, "search", done)
    return rows.select(F.col("datasourceId").alias("datasource_id"), "tag", "title", "html", "url")


@query
def crawl_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _run(spark, sf_dir, _site_table(spark, sf_dir))
    return rows.select(
        "id", "key", "domain", "tag", "flag", "searchable", "data", F.col("depth").cast("bigint").alias("depth")
    )


@query
def page_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    site_rows = _site_table(spark, sf_dir)
    rows = _run_rows(_pages(spark, sf_dir), site_rows).where(F.col("flag") >= 0)
    rows, caps = rows.select("tag", "key"), site_rows.select("tag", "maxPages")
    return discovery.cap_pages(rows, caps, ["key"])


# --- streams -----------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str, name: str, again: Column | None = None) -> DataFrame:
    """The table as a stream of four micro-batches; rows that meet the condition come a second time in the last one.

    A task writes what it reads of the table to a file of its own, and a batch takes as many files as a part has, at most.
    """
    table, path = D.table(spark, sf_dir, name), scratch_table(spark, f"stream-{name}")
    first = table.columns[0]
    third = F.pmod(F.xxhash64(first), F.lit(3))
    files, most = [0], 1
    for part in (third == 0, third == 1, third == 2, F.lit(False) if again is None else again):
        table.where(part).write.mode("append").parquet(path)
        files.append(sum(x.startswith("part-") for x in Folder(spark, path).names()))
        most = max(most, files[-1] - files[-2])
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", most).parquet(path)


@query
def stream_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_table(spark, "stream-discover")
    pages, site_rows = _pages(spark, sf_dir), _site_table(spark, sf_dir)
    known = _run_rows(pages, site_rows).select("tag", "key")
    jobs.stream_discover(
        D.responses(_stream(spark, sf_dir, "pages", F.col("page_id") % 4 == 0)),
        known,
        links.site_policy(site_rows, D.robots(pages)),
        f"{out}/frontier",
        f"{out}/progress",
        D.NOW,
    ).awaitTermination()
    return spark.read.parquet(f"{out}/frontier").select("tag", "key", "domain", "flag")


@query
def stream_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_table(spark, "stream-stats")
    events = D.frontier_events(_stream(spark, sf_dir, "events", F.col("event_id") % 4 == 0))
    jobs.stream_stats(events, f"{out}/stats", f"{out}/progress").awaitTermination()
    return jobs.streamed_stats(spark, f"{out}/stats")


@query
def stream_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_table(spark, "stream-payload")
    jobs.stream_payload(
        D.responses(_stream(spark, sf_dir, "pages")),
        _sites(spark, sf_dir),
        f"{out}/payload",
        f"{out}/progress",
    ).awaitTermination()
    written = spark.read.parquet(f"{out}/payload")
    return written.select(
        F.col("datasourceId").alias("datasource_id"), "tag", "title", "html", "url"
    )
