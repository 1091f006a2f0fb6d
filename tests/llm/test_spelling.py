"""Spelling variants against a plain version over deletion neighbourhoods."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from webfrontier.llm import spelling
from webfrontier.llm.common import documents

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, word string, n int, key string, root string"


def plain_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {word: n for word, n in counts.items() if n >= 2}


def plain_near(words):
    cut = defaultdict(set)
    for word in words:
        for at in range(len(word)):
            cut[word[:at] + word[at + 1 :], at].add(word)
    near = defaultdict(set)
    for (shorter, _), group in cut.items():
        for word in group:
            near[word] |= group - {word}
            if shorter in words:
                near[word].add(shorter)
                near[shorter].add(word)
    return near


def plain(rows):
    words = plain_counts(rows)
    near, forms = plain_near(words), {}
    for word, n in words.items():
        best = min(near[word], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 10 * n:
            forms[word] = best
    out = []
    for word, n in words.items():
        root = word
        while root in forms:
            root = forms[root]
        form = forms.get(word)
        out.append((word, form, root, n, len(near[word]), words.get(form)))
    return out


def same(found, expected):
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, "k", "r") for i, t in rows], SCHEMA)


def test_whole_table(spark):
    docs = documents(spark, SF)
    expected = plain([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    same(spelling.spelling_variants(docs), expected)
    assert any(row[1] for row in expected)


def odd_rows():
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (None, "nothing nothing anything"), (3, "x" * 5000), (4, "X" * 5000 + " " + "x" * 4999), (5, "x" * 4999)]
    # Chains of forms, ties of the largest n, and letters beyond ASCII, the multiplication sign among them.
    chain = {"abcdefgh": 1500, "abcdefgi": 120, "abcdefji": 9, "zbcdefgh": 1500, "zbcdefgx": 20, "Éclairage": 30, "éclairage": 3, "×÷×÷×÷×÷": 4, "×÷×÷×÷×": 2}
    for word, n in chain.items():
        rows += [(100 + k, " ".join([word] * (n // 3))) for k in range(3)]
    for n in range(300):
        rows.append((1000 + n, " ".join("".join(rng.choice("abc") for _ in range(rng.randint(6, 9))) for _ in range(20))))
    return [*rows, rows[-1], rows[-1], (None, "nothing")]


def test_odd_rows(spark):
    same(spelling.spelling_variants(table(spark, odd_rows())), plain(odd_rows()))


def test_few_levels_and_shares(spark):
    """Keys that are split into shares, and more levels than at first, give the same pairs."""
    for first, most in ((0, 10**6), (1, 40), (spelling.GROUPS, 5)):
        found = spelling.spelling_variants(table(spark, odd_rows()), first_levels=first, most=most)
        same(found, plain(odd_rows()))


def test_empty_table(spark):
    found = spelling.spelling_variants(table(spark, []))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"] and found.isEmpty()


@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmnopqrstuvwxyz"])
def test_trie_alone(letters):
    rng = np.random.default_rng(2)
    words = sorted({"".join(rng.choice(list(letters), rng.integers(3, 6))) for _ in range(600)})
    groups = [letters[n :: spelling.GROUPS] for n in range(spelling.GROUPS)]
    near, found = plain_near(set(words)), defaultdict(set)
    for length in (3, 4, 5):
        asked = [w for w in words if len(w) == length]
        for longer in (0, 1):
            stored = [w for w in words if len(w) == length + longer]
            if not stored:
                continue
            trie = spelling.Trie(stored, groups, 0)
            for a, b in zip(*trie.near(asked, longer, 0)):
                assert trie.words[b] not in found[asked[a]]
                found[asked[a]].add(trie.words[b])
                found[trie.words[b]].add(asked[a])
    assert {w: x for w, x in found.items() if x} == {w: x for w, x in near.items() if x}
