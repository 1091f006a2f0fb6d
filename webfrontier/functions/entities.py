"""Decoding of character references, one pass, on the JVM side."""

from __future__ import annotations

import json
from collections import defaultdict
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from webfrontier.functions.binding import let


def _names_by_first_letter() -> Column:
    """Two-level map of the HTML 4 names, so that a lookup compares few keys."""
    groups: dict[str, dict[str, str]] = defaultdict(dict)
    for name, code in sorted(name2codepoint.items()):
        groups[name[0]][name] = chr(code)
    # One text constant, which the optimizer turns into a map constant.
    return F.from_json(F.lit(json.dumps(groups)), "map<string,map<string,string>>")


def _named(name: Column) -> Column:
    table = F.try_element_at(_names_by_first_letter(), F.substring(name, 1, 1))
    return (
        F.when(name == "amp", F.lit("&"))
        .when(name == "quot", F.lit('"'))
        .when(name == "nbsp", F.lit("\u00a0"))
        .otherwise(F.try_element_at(table, name))
    )


def _numbered(name: Column) -> Column:
    digits = F.regexp_extract(name, "^#0*([0-9]{1,7})$", 1)
    hexed = F.regexp_extract(name, "^#[xX]0*([0-9a-fA-F]{1,6})$", 1)
    code = F.when(digits != "", digits.try_cast("int")).when(
        hexed != "", F.conv(hexed, 16, 10).try_cast("int")
    )

    def character(known: Column) -> Column:
        # Single quotes and control characters stay undecoded.
        valid = (
            (known.between(0x20, 0x7E) & (known != 0x27))
            | known.isin(0x09, 0x0A, 0x0D)
            | known.between(0xA0, 0xD7FF)
            | known.between(0xE000, 0x10FFFF)
        )
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(known), 8, "0")), "UTF-32"))

    return let(code, character)


def decode_entities(text: Column) -> Column:
    """Decodes every ``&name;`` and ``&#n;`` once; unknown references stay as written."""

    def after_ampersand(piece: Column, name: Column) -> Column:
        value = F.when(F.startswith(name, F.lit("#")), _numbered(name)).otherwise(_named(name))
        rest = F.substring(piece, F.length(name) + 2, F.length(piece))
        decoded = F.when(name != "", F.concat(value, rest))
        return F.coalesce(decoded, F.concat(F.lit("&"), piece))

    def one(piece: Column, position: Column) -> Column:
        name = F.regexp_extract(piece, "^(#?[0-9a-zA-Z]+);", 1)
        return F.when(position == 0, piece).otherwise(
            let(name, lambda known: after_ampersand(piece, known))
        )

    def whole(known: Column) -> Column:
        decoded = F.array_join(F.transform(F.split(known, "&"), one), "")
        return F.when(F.contains(known, F.lit("&")), decoded).otherwise(known)

    return let(text, whole)
