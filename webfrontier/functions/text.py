"""Column expressions on plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webfrontier.functions.binding import let
from webfrontier.functions.urls import ascii_lower

# Words that mark French, and how often one of them must be passed (fixed values).
FRENCH_WORDS = ["le", "la", "est", "et", "au"]
FRENCH_LIMIT = 3

# Month names of French dates (fixed values).
FRENCH_MONTHS = {
    "janvier": "01",
    "février": "02",
    "mars": "03",
    "avril": "04",
    "mai": "05",
    "juin": "06",
    "juillet": "07",
    "août": "08",
    "septembre": "09",
    "octobre": "10",
    "novembre": "11",
    "décembre": "12",
}

_SPACE = r"[ \t\n\x0B\f\r]"
_FRENCH_DATE = r"(\d{1,2}) ([^ ]*) (\d{4})"

# Search tokens: runs of letters, digits, marks and "_", joined by one "." or apostrophe between
# letters, or by one ".", "," or ";" between digits.
_TOKEN = (
    r"[\p{L}\p{N}\p{M}_]+"
    r"(?:(?:(?<=\p{L})['’.](?=\p{L})|(?<=\p{N})['.,;](?=\p{N}))[\p{L}\p{N}\p{M}_]+)*"
)


def words(text: Column) -> Column:
    """The pieces between single white-space characters, as written; punctuation stays on."""
    return F.split(text, _SPACE)


def lower_word(word: Column) -> Column:
    """Lowercases A to Z only; words of ASCII letters take the fast way."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(
        ascii_lower(word)
    )


def french_label(text: Column) -> Column:
    """``fr`` when one of the French words occurs more often than the limit, else ``not_fr``."""
    marked = rf"(?i){_SPACE}(?:{'|'.join(FRENCH_WORDS)})(?={_SPACE}|\z)"
    hits = F.regexp_extract_all(F.concat(F.lit(" "), text), F.lit(marked), F.lit(0))
    marks = F.transform(hits, lambda hit: F.lower(F.substring(hit, F.lit(2), F.length(hit))))

    def often(known: Column) -> Column:
        return F.exists(
            F.array(*[F.lit(w) for w in FRENCH_WORDS]),
            lambda mark: F.size(F.filter(known, lambda w: w == mark)) > FRENCH_LIMIT,
        )

    return F.when(let(marks, often), F.lit("fr")).otherwise(F.lit("not_fr"))


def french_date(text: Column) -> Column:
    """First ``day month year`` of the text as ``d/MM/yyyy``; NULL without one or with an unknown month."""
    months = F.create_map(*[F.lit(x) for pair in FRENCH_MONTHS.items() for x in pair])
    day, name, year = (F.regexp_extract(text, _FRENCH_DATE, i) for i in (1, 2, 3))
    return F.when(
        day != "", F.concat(day, F.lit("/"), F.try_element_at(months, name), F.lit("/"), year)
    )


def search_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))
