"""Substring dedup by recompression: windows of 50 words that smaller documents have too.

A text is compressed in rounds. A round first names runs of one symbol and then pairs of a symbol of the left and one
of the right half of the alphabet. A name is a hash of what it stands for, so all tasks give it alike, and equal
passages get equal symbols inside; only near their ends symbols depend on what is around them. Every symbol
carries the stretch of words that decided it, and a window is known by the highest symbol that its own words decide,
so two equal windows always meet at one symbol.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from webfrontier.llm.common import id_back, id_column, whole_text
from webfrontier.llm.repeats import Rolling, earlier_windows, map_spans, merged_spans, runs_of
from webfrontier.llm.shingles import mixed, word_bounds, word_hashes

#: Most words of a symbol after each round.
ROUNDS = (4, 6, 9, 13, 18)
WINDOW = 50


class Symbols:
    """A text at one level: names, first and end words, and the words from ``low`` to ``high`` that decided them."""

    def __init__(self, name, first, end, low, high) -> None:
        self.name, self.first, self.end, self.low, self.high = name, first, end, low, high

    def around(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """What decides the symbol before and the one behind; the ends of the text lie outside every window."""
        return np.concatenate([[-1], self.low[:-1]]), np.concatenate([self.high[1:], [words + 1]])

    def joined(self, begins: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> Symbols:
        at = np.flatnonzero(begins)
        ends = self.end[np.append(at[1:], len(self.end)) - 1]
        return Symbols(name[at], self.first[at], ends, np.minimum.reduceat(low, at), np.maximum.reduceat(high, at))


def name_runs(text: Symbols, words: int, most: int) -> Symbols:
    """Runs of one symbol become one, unless they have over ``most`` words."""
    fresh = np.concatenate([[True], text.name[1:] != text.name[:-1]])
    at = np.flatnonzero(fresh)
    counts = np.diff(np.append(at, len(fresh)))
    group = np.cumsum(fresh) - 1
    times = counts[group]
    whole = (times > 1) & (times * (text.end - text.first) <= most)
    name = np.where(whole, mixed(text.name + times.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)), text.name)
    before, behind = text.around(words)
    low = np.minimum.reduceat(np.minimum(text.low, before), at)[group]
    high = np.maximum.reduceat(np.maximum(text.high, behind), at)[group]
    return text.joined(fresh | ~whole, name, low, high)


def name_pairs(text: Symbols, words: int, most: int, number: int) -> Symbols:
    """A left symbol and a right one behind it become one, unless they have over ``most`` words."""
    right = (mixed(text.name + np.uint64(number * 0x632BE59BD9B4E019 % 2**64)) >> np.uint64(63)).astype(bool)
    size = text.end - text.first
    bar = (text.low < 0) & (text.high > words)  # ends of texts, and what hangs on both ends of its own, stay alone
    pair = np.zeros(len(right), bool)
    pair[:-1] = ~right[:-1] & right[1:] & (size[:-1] + size[1:] <= most) & ~bar[:-1] & ~bar[1:]
    second = np.concatenate([[False], pair[:-1]])
    name = text.name.copy()
    a, b = text.name[:-1][pair[:-1]], text.name[1:][pair[:-1]]
    name[pair] = mixed(mixed(a) + b * np.uint64(0xC2B2AE3D27D4EB4F))
    before, behind = text.around(words)
    alone = ~pair & ~second
    low = np.where(alone & right, np.minimum(text.low, before), text.low)
    high = np.where(alone & ~right, np.maximum(text.high, behind), text.high)
    return text.joined(~second, name, low, high)


def levels(words: np.ndarray, ends: np.ndarray) -> Iterator[Symbols]:
    """The texts before and after every round. ``ends`` are the places of symbols that stand between texts."""
    place = np.arange(len(words))
    low, high = place.copy(), place + 1
    low[ends], high[ends] = -1, len(words) + 1  # no window has them in it
    text = Symbols(words, place, place + 1, low, high)
    yield text
    for number, most in enumerate(ROUNDS):
        text = name_pairs(name_runs(text, len(words), most), len(words), most, number)
        yield text


def window_symbols(words: np.ndarray, ends: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Name and first word of the symbol by which every wanted window is known: of the symbols that its words
    decide, those of the highest level, of these the smallest by a hash, of equal ones the first."""
    count = len(words) - WINDOW + 1
    names, firsts = np.zeros(count, np.uint64), np.where(wanted, -1, 0)
    for number, text in reversed(list(enumerate(levels(words, ends)))):
        order = mixed(text.name ^ np.uint64(0x5851F42D4C957F2D))
        begin, last = np.maximum(text.high - WINDOW, 0), np.minimum(text.low, count - 1)
        # only symbols of windows that no higher level has told are looked at
        missing = np.concatenate([[0], np.cumsum(firsts < 0)])
        fits = np.flatnonzero((last >= begin) & (text.low >= 0) & (text.high <= len(words)))
        fits = fits[missing[last[fits] + 1] > missing[begin[fits]]]
        chosen = np.full(count, -1)
        ranked = fits[np.lexsort((-text.first[fits], ~order[fits]))]  # the last one painted stays
        for symbol, a, b in zip(ranked.tolist(), begin[ranked].tolist(), (last[ranked] + 1).tolist()):
            chosen[a:b] = symbol
        new = np.flatnonzero((firsts < 0) & (chosen >= 0))
        names[new] = mixed(text.name[chosen[new]] + np.uint64(number))
        firsts[new] = text.first[chosen[new]]
        if (firsts >= 0).all():
            break
    return names, firsts


def text_words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends (in bytes) of the words of a text."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends = word_bounds(data)
    return word_hashes(data, starts, ends, fold_case=False), starts, ends


def runs(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Number of the text, key, content, first window, number of windows and anchor of all runs of some texts.

    The texts are laid one behind another, with a symbol between them that is like no word.
    """
    own = [text_words(x)[0] for x in texts]
    parts = [np.zeros(1, np.uint64)]
    for number, words in enumerate(own):
        parts += [words, mixed(np.array([~number], np.int64).view(np.uint64))]
    words = np.concatenate(parts)
    sizes = np.array([len(x) for x in own])
    ends = np.concatenate([[0], np.cumsum(sizes + 1)])
    if len(words) < WINDOW or sizes.max() < WINDOW:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    place = np.arange(len(words) - WINDOW + 1)
    borders = np.zeros(len(words) + 1, np.int64)
    borders[ends + 1] = 1
    borders = np.cumsum(borders)
    wanted = borders[place] == borders[place + WINDOW]  # no symbol between texts is inside
    names, firsts = window_symbols(words, ends, wanted)
    # symbols of two levels may begin at one word, so the name counts besides the place
    start, count = runs_of(np.where(wanted, firsts, -1 - place), names)
    kept = wanted[start]
    start, count = start[kept], count[kept]
    content = Rolling(words).stretch(start, start + count - 1 + WINDOW)
    number = np.searchsorted(ends, start, side="right") - 1
    origin = ends[number] + 1
    return number, names[start].view(np.int64), content, start - origin, count, firsts[start] - origin


def values(text: str) -> np.ndarray:
    return text_words(text)[0]


def without_spans(text: str, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    """Number of words, of removed words, and the digest of the kept ones joined by spaces."""
    words = text.encode().split()
    kept, at = [], 0
    for start, end in merged_spans(spans, len(words)):
        kept += words[at:start]
        at = end
    kept += words[at:]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    Removed is each word of a window of 50 words that a document with a smaller doc_id also has. A null text has no
    words; a null doc_id is the smallest. Rows with one doc_id count as one document: their spans are shared and cut to each text.
    """
    rows = docs.select(id_column().alias("doc_id"), whole_text().alias("text"))
    spans = earlier_windows(rows, runs, values, WINDOW, within=False, block=6, store=True)
    found = map_spans(rows, spans, without_spans, "n_words long, n_removed long, kept_sha256 string")
    return found.select(id_back(), "n_words", "n_removed", "kept_sha256")
