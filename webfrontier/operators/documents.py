"""Documents made from pages, and labels, words, dates and parameters read out of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webfrontier.functions.binding import let
from webfrontier.functions.html import page_text, page_title
from webfrontier.functions.text import french_date, french_label, lower_word, words
from webfrontier.functions.urls import query_pairs, url_domain, url_scheme
from webfrontier.operators.links import page_links
from webfrontier.operators.unnest import unnest
from webfrontier.sources.responses import mark_crawlable


def extract_titles(responses: DataFrame) -> DataFrame:
    """Adds ``title`` for crawlable responses that have one."""
    return mark_crawlable(responses).withColumn(
        "title", F.when(F.col("crawlable"), page_title(F.col("body")))
    )


def extract_text(responses: DataFrame) -> DataFrame:
    """Adds ``text``, the visible text of crawlable responses."""
    return mark_crawlable(responses).withColumn(
        "text", F.when(F.col("crawlable"), page_text(F.col("body")))
    )


def page_documents(responses: DataFrame, crawl_time: str, keep: list[str] | None = None) -> DataFrame:
    """One document per crawlable response; one narrow stage from page to document."""

    def of_kind(kind: str) -> Column:
        chosen = F.filter("links", lambda x: x["link_type"] == kind)
        return F.transform(chosen, lambda x: x["link"]).alias(f"{kind}_links")

    documents = page_links(responses).where("crawlable")
    return documents.select(
        *(keep or []),
        "url",
        of_kind("internal"),
        of_kind("external"),
        F.lit(crawl_time).alias("crawl_time"),
        url_domain(F.col("url")).alias("domain"),
        page_text(F.col("body")).alias("body"),
        F.col("body").alias("html"),
        "headers",
        page_title(F.col("body")).alias("title"),
    )


def count_by_domain(rows: DataFrame, url_col: str = "url") -> DataFrame:
    return rows.groupBy(url_domain(F.col(url_col)).alias("domain")).agg(
        F.count(F.lit(1)).alias("pages")
    )


def count_by_scheme(rows: DataFrame, url_col: str = "url") -> DataFrame:
    return rows.groupBy(url_scheme(F.col(url_col)).alias("scheme")).agg(
        F.count(F.lit(1)).alias("pages")
    )


def label_language(rows: DataFrame, text_col: str, out: str = "label") -> DataFrame:
    return rows.withColumn(out, french_label(F.col(text_col)))


def language_confusion(rows: DataFrame, text_col: str, truth_col: str) -> DataFrame:
    """How often each label meets each known language."""
    return (
        label_language(rows, text_col)
        .groupBy(truth_col, "label")
        .agg(F.count(F.lit(1)).alias("documents"))
    )


def word_counts(rows: DataFrame, key: str, text_col: str) -> DataFrame:
    """``(key, word, n)``; a task counts its own rows before anything is shuffled."""
    found = unnest(rows, [key], words(F.col(text_col)), "word")
    return found.groupBy(key, lower_word(F.col("word")).alias("word")).agg(F.count(F.lit(1)).alias("n"))


def french_dates(rows: DataFrame, text_col: str, out: str = "french_date") -> DataFrame:
    return rows.withColumn(out, french_date(F.col(text_col)))


def query_params(rows: DataFrame, url_col: str, keep: list[str] | None = None) -> DataFrame:
    """One row per query parameter of each URL."""
    return unnest(rows, keep or [url_col], query_pairs(F.col(url_col)))
