"""Column expressions on raw HTTP data: headers, charsets, broken bytes, form bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webfrontier.functions.urls import ascii_lower, last_per_name, strip_blanks

# Byte sequences that are well-formed UTF-8, seen as one character per byte.
_GOOD_BYTES = (
    r"[\x00-\x7F]"
    r"|[\xC2-\xDF][\x80-\xBF]"
    r"|\xE0[\xA0-\xBF][\x80-\xBF]"
    r"|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}"
    r"|\xED[\x80-\x9F][\x80-\xBF]"
    r"|\xF0[\x90-\xBF][\x80-\xBF]{2}"
    r"|[\xF1-\xF3][\x80-\xBF]{3}"
    r"|\xF4[\x80-\x8F][\x80-\xBF]{2}"
)


def header_map(raw: Column) -> Column:
    """Lowercased header names to values, from the text of all header blocks; the last one wins."""
    lines = F.filter(F.split(raw, "\n"), lambda line: F.contains(line, F.lit(":")))
    pairs = F.transform(
        lines,
        lambda line: F.struct(
            ascii_lower(strip_blanks(F.split_part(line, F.lit(":"), F.lit(1)))).alias("name"),
            strip_blanks(
                F.substring(line, F.instr(line, ":") + F.lit(1), F.length(line))
            ).alias("value"),
        ),
    )
    return F.map_from_entries(last_per_name(pairs))


def drop_broken_bytes(raw: Column) -> Column:
    """Bytes to text; bytes outside well-formed UTF-8 sequences are left out."""
    per_byte = F.decode(raw, "ISO-8859-1")
    good = F.array_join(F.regexp_extract_all(per_byte, F.lit(f"(?:{_GOOD_BYTES})++"), F.lit(0)), "")
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(
        F.encode(good, "ISO-8859-1").cast("string")
    )


def body_text(raw: Column, content_type: Column) -> Column:
    """Bytes to text by the charset of the content type: Latin-1 when named, else UTF-8."""
    latin = F.contains(F.lower(content_type), F.lit("iso-8859-1"))
    return F.when(latin, F.decode(raw, "ISO-8859-1")).otherwise(drop_broken_bytes(raw))


def form_encode(value: Column) -> Column:
    """Form encoding: letters, digits and ``-_.`` stay, a space becomes ``+``."""
    return F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A"))


def form_body(fields: dict[str, Column]) -> Column:
    """``name=value`` pairs joined by ``&``; NULL fields are left out."""
    return F.concat_ws(
        "&",
        *[F.concat(form_encode(F.lit(name)), F.lit("="), form_encode(v)) for name, v in fields.items()],
    )
