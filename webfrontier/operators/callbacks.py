"""What is handed on for every processed page: user-defined projections and their registry."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webfrontier.functions.html import page_title
from webfrontier.functions.http import form_body
from webfrontier.model import RESPONSES
from webfrontier.operators.skew import spread_join
from webfrontier.sources.responses import mark_crawlable


class Callback(Protocol):
    """A projection of processed pages ``(tag, url, title, html)``; ``settings_fields`` are the site settings it reads, which
    the pages have as columns too."""

    settings_fields: list[str]

    def project(self, documents: DataFrame) -> DataFrame: ...


class SearchPayload:
    """``(tag, datasourceId, title, html, url)`` for sites with a ``callbackUrl``; empty values are NULL."""

    settings_fields = ["datasourceId", "callbackUrl"]

    def project(self, documents: DataFrame) -> DataFrame:
        def filled(name: str):
            return F.nullif(F.col(name), F.lit("")).alias(name)

        named = [filled(n) for n in ("datasourceId", "title", "html", "url")]
        return documents.where(F.col("callbackUrl").isNotNull()).select("tag", *named)


REGISTRY: dict[str, Callback] = {"search": SearchPayload()}


def register(name: str, callback: Callback) -> None:
    REGISTRY[name] = callback


def finished_pages(responses: DataFrame) -> DataFrame:
    """All finished pages with ``title`` and ``html``; failed ones have neither. Columns that the responses have besides stay."""
    marked = mark_crawlable(responses)
    html = F.when(F.col("crawlable"), F.col("body"))
    kept = [name for name in responses.columns if name not in RESPONSES.fieldNames() or name == "url"]
    return marked.select(*kept, page_title(html).alias("title"), html.alias("html"))


def payload(
    responses: DataFrame, sites: DataFrame, callback: str, processed: DataFrame | None = None
) -> DataFrame:
    """What one callback makes of the finished pages of the sites that name it in their ``callback`` setting.

    Sites without a callback, or with one that is not registered, get nothing. ``processed`` is
    ``(tag, key)`` of the pages a run has processed, as ``crawl`` returns them in the state done; pages it
    never reached, or that its cap stopped, are left out. Without it all responses count as processed.

    Settings are joined once. With ``processed`` they first go to the keys of pages, which are short, and these meet the
    responses by (tag, url); responses that ``store_responses`` keeps stay where they lie, so no body is shuffled.
    """
    fields = REGISTRY[callback].settings_fields
    chosen = sites.where(F.col("callback") == callback).select("tag", *fields)
    if processed is None:
        responses = responses.select("tag", *RESPONSES.fieldNames())
        pages = spread_join(responses, chosen, ["tag"], "inner", ["url"])
    else:
        keys = processed.select("tag", F.col("key").alias("url")).distinct()
        keys = spread_join(keys, chosen, ["tag"], "inner", ["url"])
        pages = responses.select("tag", *RESPONSES.fieldNames()).join(keys, ["tag", "url"])
    return REGISTRY[callback].project(finished_pages(pages))


def store_responses(responses: DataFrame, table: str, path: str, buckets: int, mode: str = "overwrite") -> DataFrame:
    """Keeps responses as a table at ``path``, bucketed and sorted by (tag, url): joins on these columns read it where it lies."""
    rows = responses.select("tag", *RESPONSES.fieldNames()).repartition(buckets, "tag", "url")
    kept = rows.write.bucketBy(buckets, "tag", "url").sortBy("tag", "url").mode(mode).format("parquet").option("path", path)
    kept.saveAsTable(table)
    return responses.sparkSession.table(table)


def deliver(
    responses: DataFrame, sites: DataFrame, path: str, processed: DataFrame | None = None, mode: str = "append"
) -> None:
    """Writes the payload of every registered callback to a folder of its name."""
    for name in sorted(REGISTRY):
        rows = payload(responses, sites, name, processed)
        rows.write.mode(mode).parquet(f"{path.rstrip('/')}/callback={name}")


def with_form_body(rows: DataFrame, out: str = "form") -> DataFrame:
    """Adds the payload as a form-encoded request body."""
    names = ("datasourceId", "title", "html", "url")
    return rows.withColumn(out, form_body({name: F.col(name) for name in names}))
