"""Column expressions on URLs."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from webfrontier.functions.binding import let

# White space stripped from both ends of a value (fixed value): space, tab, newline, return, NUL, vertical tab.
BLANKS = " \t\n\r\0\x0b"


def ascii_lower(text: Column) -> Column:
    """Lowercases A to Z only; other letters stay as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def strip_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def url_domain(url: Column) -> Column:
    """Lowercased text between the first ``//`` and the next ``/``; NULL without ``//``."""
    after = F.get(F.split(url, "//"), F.lit(1))
    return ascii_lower(F.split_part(after, F.lit("/"), F.lit(1)))


def url_scheme(url: Column) -> Column:
    """Lowercased text before ``://``; NULL without it."""
    return F.when(F.contains(url, F.lit("://")), ascii_lower(F.split_part(url, F.lit("://"), F.lit(1))))


def url_path(url: Column) -> Column:
    """Path and query of an absolute URL, always starting with ``/``."""
    rest = F.regexp_replace(url, r"^[^:/?#]*://[^/?#]*", "")
    return F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))


def classify_link(href: Column, domain: Column, scheme: Column) -> Column:
    """``struct(link, link_type)`` for an href found on a page of that domain and scheme; NULL when dropped."""
    site = F.concat(F.coalesce(scheme, F.lit("")), F.lit("://"), F.coalesce(domain, F.lit("")))
    absolute = F.when(
        F.startswith(href, F.lit("//")), F.concat(F.lit("http:"), href)
    ).otherwise(href)
    return let(absolute, lambda target: _by_target(target, site))


def _by_target(target: Column, site: Column) -> Column:
    def begins(prefix) -> Column:
        return F.startswith(target, prefix if isinstance(prefix, Column) else F.lit(prefix))

    def keep(link: Column, kind: str) -> Column:
        return F.struct(trim_link(link).alias("link"), F.lit(kind).alias("link_type"))

    # The order of the cases decides; every test is case-sensitive.
    return (
        F.when(F.contains(target, F.lit("#")), F.lit(None))
        .when(begins("/"), keep(F.concat(site, target), "internal"))
        .when(begins("."), keep(F.concat(site, F.lit("/"), target), "internal"))
        .when(begins(site), keep(target, "internal"))
        .when(begins("http"), keep(target, "external"))
        .when(begins("mailto:"), F.lit(None))
        .otherwise(keep(F.concat(site, F.lit("/"), target), "internal"))
    )


def trim_link(link: Column) -> Column:
    return F.btrim(strip_blanks(link), F.lit("/"))


def query_pairs(url: Column) -> Column:
    """Array of ``struct(name, value)`` from the query string of a URL with exactly one ``?``.

    Only parts with exactly one ``=`` count, and the last of several equal names wins.
    """
    halves = F.split(url, r"\?")
    parts = F.transform(F.split(F.get(halves, F.lit(1)), "&"), lambda part: F.split(part, "="))
    pairs = F.transform(
        F.filter(parts, lambda p: F.size(p) == 2),
        lambda p: F.struct(p[0].alias("name"), p[1].alias("value")),
    )
    return F.when(F.size(halves) == 2, last_per_name(pairs))


def last_per_name(pairs: Column) -> Column:
    """Keeps one pair per name, the last one, without leaving the row; pairs come out by name."""
    placed = F.transform(
        pairs,
        lambda p, i: F.struct(p["name"].alias("name"), i.alias("place"), p["value"].alias("value")),
    )

    def last(known: Column) -> Column:
        ends = F.filter(known, lambda p, i: ~F.get(known, i + 1)["name"].eqNullSafe(p["name"]))
        return F.transform(
            ends, lambda p: F.struct(p["name"].alias("name"), p["value"].alias("value"))
        )

    return let(F.array_sort(placed), last)
