"""Phrase collocations against a plain count of all n-grams, and against the SQL."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import zstandard

from webfrontier.llm import collocations
from webfrontier.llm.common import documents
from webfrontier.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, w1 string, n string, phrase int"


def plain(rows, min_count, top=2000):
    counts, sizes = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            sizes[lang] += len(words)
            counts.update((lang, tuple(words[i : i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= min_count}
    longer = defaultdict(int)
    for (lang, words), f in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                longer[lang, words[i : i + k]] = max(longer[lang, words[i : i + k]], f)
    found = defaultdict(list)
    for (lang, words), a in candidates.items():
        if 100 * longer[lang, words] >= 80 * a:
            continue
        cuts = [(counts[lang, words[:k]], counts[lang, words[k:]]) for k in range(1, len(words))]
        score, _, l, r = min((2_000_000 * a // (l + r), k, l, r) for k, (l, r) in enumerate(cuts))
        found[lang].append((-score, -a, " ".join(words).encode(), l, r))
    out = []
    for lang, group in found.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(group)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, sizes[lang], -score))
    return out


def same(found, expected):
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected))


def odd_rows():
    rng = random.Random(11)
    words = ["a", "B", "b", "ab", "Éa", "éa", "日本", "x\x00y", "\x1c", " ", "'s", "a" * 300]
    rows = [(1, None, "en"), (2, "", "en"), (3, " \t ", None), (4, ".,;\n", "fr"), (5, "a a a a a a a", None)]
    for n in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\r\n", ",", "\x0b"]) for _ in range(40))
        rows.append((n, text, rng.choice(["en", "en", "en", "de", None, "und", ""])))
    rows.append((None, "Very long very long text; " * 20_000, "long"))
    return [*rows, rows[10], rows[10]]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, t, lang, "w", "n", 3) for i, t, lang in odd_rows()], SCHEMA).repartition(4)


@pytest.mark.parametrize(("min_count", "top"), [(1, 2000), (5, 40), (300, 2000)])
def test_odd_rows(table, min_count, top):
    expected = plain([(lang, t) for _, t, lang in odd_rows()], min_count, top)
    same(collocations.collocations(table, min_count, top), expected)
    assert expected


def test_empty_table(table):
    found = collocations.collocations(table.limit(0))
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and found.isEmpty()


def test_query_is_the_plain_count_and_its_sql(spark):
    found = QUERIES["op12_phrase_mining"](spark, SF)
    rows = [(r["lang"], r["text"]) for r in documents(spark, SF).select("lang", "text").collect()]
    same(found, plain(rows, 30))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    same(found, duck.execute(f"SELECT {', '.join(found.columns)} FROM ({ORACLE['op12_phrase_mining']})").fetchall())


def test_windows_are_the_longest_ones(table):
    """Only windows are counted, one per word: their number is the number of words."""
    counted = collocations.window_counts(table, 1).where("lang = 'long'").collect()
    assert {tuple(r[:6]) for r in counted} == {
        ("long", "very", "long", "very", "long", 20_000), ("long", "long", "very", "long", "text", 20_000),
        ("long", "very", "long", "text", "", 20_000), ("long", "long", "text", "", "", 20_000), ("long", "text", "", "", "", 20_000),
    }


def test_slots_do_not_fill_up(spark):
    """Pairs that are there once stay below the count even where many of them share a slot's first 26 bits."""
    words = [f"w{n}" for n in range(450)]
    rows = [(n, ". ".join(f"{a} {b}" for b in words), "en", "w", "n", 3) for n, a in enumerate(words)]
    counted = collocations.window_counts(spark.createDataFrame(rows, SCHEMA).repartition(3), 2)
    assert counted.where("w2 <> ''").count() < 100
    assert counted.agg({"n": "sum"}).first()[0] == 2 * 450 * 450


def test_slots_travel_whole():
    """Blocks come out as they went in, whatever the distances, and counts are added up to 255."""
    top = (1 << collocations.SLOT_BITS) - 1
    slots = np.array([0, 1, 70_000, (1 << 24) - 1, 1 << 24, top - 300, top], dtype=np.uint64)
    parts = [(slots << np.uint64(8)) | np.uint64(n) for n in (1, 200, 60)]
    found, unpack = [], zstandard.ZstdDecompressor()
    for batch in collocations._packed_blocks([*parts[:2], parts[2][::2]]):
        for block, *planes in zip(*(column.to_pylist() for column in batch.columns)):
            found += [((block << 24) + int(x >> 8), int(x & 255)) for x in collocations._unpacked(planes, unpack)]
    assert found == [(int(x), 255 if n % 2 == 0 else 201) for n, x in enumerate(slots)]


def test_full_slots_find_room_in_the_table():
    """Every full slot is found in the table, whatever its size, and most others are not."""
    rng, blocks = np.random.default_rng(5), {}
    slots = rng.choice(1 << collocations.SLOT_BITS, 20_000, replace=False).astype(np.uint64)
    rows = list(collocations._packed_blocks([np.sort((slots << np.uint64(8)) | np.uint64(30))]))
    n = 0
    for batch in collocations._full_slots(30)(iter(rows)):
        for row in batch.to_pylist():
            blocks[row["block"]] = row["bits"]
            n += row["n"]
    for size, table in ((21, collocations._table(blocks, n)), (20, collocations._table({}, 0))):
        assert 8 * len(table) == 1 << size
    bits = np.unpackbits(collocations._table(blocks, n))
    assert bits[slots >> np.uint64(collocations.SLOT_BITS - 21)].all() and bits.mean() < 1 / 64
    assert not list(collocations._full_slots(31)(iter(rows)))


def test_texts_are_cut_into_windows_once(table):
    """All counts come from one reading of the texts and one exchange of the windows."""
    found = collocations.phrase_counts(collocations.window_counts(table, 5))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
