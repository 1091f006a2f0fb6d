"""Hashes of words and of word shingles, for whole texts at a time."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
_SAME = np.arange(256, dtype=np.uint8)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads every 64-bit value over all bits, one to one."""
    values = values.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        values = (values ^ (values >> np.uint64(shift))) * np.uint64(factor)
    return values ^ (values >> np.uint64(31))


def _series(count: int, salt: int) -> np.ndarray:
    return mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_BYTE[_BLANK] = 0
_PLACE = [_series(1 << 12, 7)]
_TURN = _series(SHINGLE, 11)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 bytes; words are separated by ASCII blanks."""
    blank = np.concatenate([[True], _BLANK[data], [True]])
    turns = np.flatnonzero(blank[1:] != blank[:-1])
    return turns[::2], turns[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool) -> np.ndarray:
    """One 64-bit hash per word, with A-Z taken as a-z if asked."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    while len(_PLACE[0]) < lengths.max() + 1:
        _PLACE[0] = _series(2 * len(_PLACE[0]), 7)
    begins = np.zeros(len(data), np.int64)
    begins[starts[1:]] = np.diff(starts)
    begins = np.cumsum(begins) + starts[0]
    place = np.minimum(np.maximum(np.arange(len(data)) - begins, 0), len(_PLACE[0]) - 1)
    terms = _BYTE[(_SMALL if fold_case else _SAME)[data]] * _PLACE[0][place]
    return mixed(np.add.reduceat(terms, starts) + lengths.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def shingle_set(text: str) -> np.ndarray:
    """Sorted hashes of the different five-word shingles, letters A-Z folded.

    A text with fewer words has its whole sequence as one shingle, one without words has none.
    """
    data = np.frombuffer(text.encode(), np.uint8)
    words = word_hashes(data, *word_bounds(data), fold_case=True)
    if not len(words):
        return words
    width = min(SHINGLE, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        total += words[k : len(words) - width + 1 + k] * _TURN[k]
    return np.unique(mixed(total))
