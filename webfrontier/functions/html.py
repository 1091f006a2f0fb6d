"""Column expressions that read anchors, titles and visible text out of HTML.

They work on the text of the page and build no tree. Limits: a tag broken across stray quotes is
read up to its next ``>``, and an unclosed title is taken as missing. A comment, script or style that is not
closed runs to the end of the page. Every pattern consumes what it has read, also where no end follows,
so a page costs time in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webfrontier.functions.binding import let
from webfrontier.functions.entities import decode_entities
from webfrontier.functions.urls import classify_link, strip_blanks

_SPACE = r"[ \t\n\x0B\f\r]"
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""
_NAME = r"""[^\s=>"'/]++"""

# Comments, scripts and styles hold no elements, so they go before anything is searched.
_HIDDEN = (
    r"(?s)<(?:!--.*?(?:-->|\z)"
    r"|(?i:script)\b.*?(?:</(?i:script)\s*+>|\z)"
    r"|(?i:style)\b.*?(?:</(?i:style)\s*+>|\z))"
)

# A whole anchor tag: well-formed attributes, or else everything up to the next ">" or the end of the page.
_ANCHOR = (
    rf"(?is)<a(?=[\s/])(?:(?:[\s/]*+{_NAME}(?:\s*+=\s*+{_VALUE})?+)*+[\s/]*+>|[^>]*+(?:>|\z))"
)
# Inside a tag: skip the attributes before href, then take its value.
_TO_HREF = (
    rf"(?is)^<a(?=[\s/])(?:[\s/]*+(?!href[\s=/>]){_NAME}(?:\s*+=\s*+{_VALUE})?+)*+[\s/]*+href"
)
_HREF = rf"{_TO_HREF}\s*+=\s*+({_VALUE})"
_HREF_BARE = rf"{_TO_HREF}(?:[\s/]*+>|\s++[^\s=]|\s*+=\s*+>)"
_HREF_LOOSE = rf"(?is)^<a\b[^>]*?\shref\s*+=\s*+({_VALUE})"

_TITLE_END = r"</title\s*+>"
_TITLE = rf"(?is)<title(?:\s[^>]*+)?+(?:>(?:(.*?){_TITLE_END}|.*+)|\z)"

# Patterns of the visible-text rule (fixed values).
_BODY = r"(?is)<body[^>]*+(?:>(.*?)(?:</body\s*+>|\z)|\z)"
_TAG = r"<[^>]++>"


def visible_markup(html: Column) -> Column:
    return F.regexp_replace(html, _HIDDEN, " ")


def _unquote(value: Column) -> Column:
    inner = F.substring(value, F.lit(2), F.length(value) - 2)
    return F.when(F.substring(value, 1, 1).isin('"', "'"), inner).otherwise(value)


def anchor_hrefs(html: Column) -> Column:
    """Decoded href of every anchor that has one, in page order."""

    def href(tag: Column) -> Column:
        loose = let(
            F.regexp_extract(tag, _HREF_LOOSE, 1),
            lambda value: F.when(value != "", _unquote(value)),
        )
        return let(
            F.regexp_extract(tag, _HREF, 1),
            lambda value: F.when(value != "", _unquote(value))
            .when(F.rlike(tag, F.lit(_HREF_BARE)), F.lit(""))
            .otherwise(loose),
        )

    found = F.regexp_extract_all(visible_markup(html), F.lit(_ANCHOR), F.lit(0))
    tags = F.filter(found, lambda tag: F.endswith(tag, F.lit(">")))
    return F.transform(
        F.filter(F.transform(tags, href), lambda value: value.isNotNull()), decode_entities
    )


def page_link_array(html: Column, domain: Column, scheme: Column) -> Column:
    """Distinct ``struct(link, link_type)`` of a page, first occurrence first."""
    links = F.transform(anchor_hrefs(html), lambda href: classify_link(href, domain, scheme))
    # Texts are compared by hash, structs one with another: so each link is one text meanwhile.
    texts = F.transform(
        F.filter(links, lambda found: found.isNotNull()),
        lambda found: F.concat(found["link_type"], F.lit(" "), found["link"]),
    )

    def parts(text: Column) -> Column:
        kind = F.split_part(text, F.lit(" "), F.lit(1))
        link = F.substring(text, F.length(kind) + 2, F.length(text))
        return F.struct(link.alias("link"), kind.alias("link_type"))

    return F.transform(F.array_distinct(texts), parts)


def page_title(html: Column) -> Column:
    """First title, decoded and trimmed; NULL when there is none."""

    def inner(element: Column) -> Column:
        closed = F.rlike(element, F.lit(f"(?i){_TITLE_END}$"))
        return F.when(closed, F.regexp_extract(element, _TITLE, 1))

    found = F.regexp_extract(visible_markup(html), _TITLE, 0)
    return strip_blanks(decode_entities(let(found, inner)))


def _without_blocks(text: Column, name: str) -> Column:
    """Drops all from ``<name`` over the next ``>`` to the next ``</name>``.

    Behind the last end tag nothing can match, so it is not searched. Before it, a start without an
    end of its own is read up to its ``>`` and kept, for no start inside that stretch has an end either.
    """
    pattern = rf"(?is)<{name}[^>]*+>.*?</{name}>|(<{name}[^>]*+>)"

    def cleaned(head: Column) -> Column:
        rest = F.substring(text, F.length(head) + 1, F.length(text))
        return F.concat(F.regexp_replace(head, pattern, "$1"), rest)

    return let(F.regexp_extract(text, rf"(?is)^.*</{name}>", 0), cleaned)


def _without_tags(text: Column) -> Column:
    """Puts a space for every ``<...>``; behind the last ``>`` there is none."""

    def cleaned(size: Column) -> Column:
        head = F.substring(text, F.lit(1), size)
        return F.concat(
            F.regexp_replace(head, _TAG, " "), F.substring(text, size + 1, F.length(text))
        )

    size = F.length(text) - F.instr(F.reverse(text), ">") + 1
    return let(F.when(F.contains(text, F.lit(">")), size).otherwise(F.lit(0)), cleaned)


def page_text(html: Column) -> Column:
    """Visible text of the page body with single spaces."""

    def body_of(known: Column) -> Column:
        inner = F.regexp_extract(known, _BODY, 1)
        return F.when(F.rlike(known, F.lit("(?i)<body")), inner).otherwise(known)

    body = let(F.regexp_replace(html, "&nbsp;|&rsquo;", " "), body_of)
    bare = let(let(body, lambda x: _without_blocks(x, "script")), lambda x: _without_blocks(x, "style"))
    # References are decoded first, so escaped tags vanish with the real ones.
    text = let(decode_entities(bare), _without_tags)
    return strip_blanks(F.regexp_replace(text, f"{_SPACE}+", " "))
