"""Suffix-array dedup: bytes of strings of 100 bytes that also start earlier in the corpus."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from webfrontier.llm.common import id_back, id_column, whole_text
from webfrontier.llm.repeats import Rolling, earlier_windows, map_spans, merged_spans, runs_of
from webfrontier.llm.shingles import mixed

WINDOW = 100
#: A window is known by the smallest, by a hash, of the strings of so many bytes in it.
GRAM = 24
#: Short texts are looked at together, so many bytes at a time.
_CHUNK = 1 << 15
_LETTER = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from every place on."""
    padded = np.ascontiguousarray(data)
    count = len(padded) - GRAM + 1
    total = np.zeros(count, np.uint64)
    for at, factor in zip(range(0, GRAM, 8), (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)):
        eight = np.ndarray((count,), "<u8", padded.tobytes()[at:] + bytes(8), strides=(1,))
        total = (total ^ eight) * np.uint64(factor)
        total ^= total >> np.uint64(29)
    return mixed(total)


def window_anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the place of the smallest gram of every window, of equal ones the first."""
    grams = gram_hashes(data)
    value, reach, width = grams, 1, WINDOW - GRAM + 1
    while reach < width:
        step = min(reach, width - reach)
        value = np.minimum(value[:-step], value[step:])
        reach += step
    # The place changes where the hash does, and behind a gram that comes again in the windows after it.
    begin = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    first = begin + np.argmax(np.lib.stride_tricks.sliding_window_view(grams, width)[begin] == value[begin, None], axis=1)
    last = np.append(begin[1:], len(value)) - 1
    place = np.repeat(first, last - begin + 1)
    for run in np.flatnonzero(last > first):
        at, end = begin[run], last[run] + 1
        hits = first[run] + np.flatnonzero(grams[first[run] : end - 1 + width] == value[at])
        place[at:end] = hits[hits.searchsorted(np.arange(at, end))]
    return value, place


def runs(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Number of the text, key, content, first window, number of windows and anchor of all runs of some texts."""
    found = [tuple(np.zeros(0, np.int64) for _ in range(6))]
    held, size = [], 0
    for number, text in enumerate(texts):
        data = text.encode()
        if len(data) >= WINDOW:
            held.append((number, data))
            size += len(data)
        if size >= _CHUNK:
            found.append(_runs_together(held))
            held, size = [], 0
    if held:
        found.append(_runs_together(held))
    return tuple(map(np.concatenate, zip(*found)))


def _runs_together(texts: list[tuple[int, bytes]]) -> tuple[np.ndarray, ...]:
    """The runs of numbered texts, laid end to end; windows across a seam are left out."""
    numbers, sizes = np.array([x for x, _ in texts]), np.array([len(x) for _, x in texts])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(x for _, x in texts), np.uint8)
    names, places = window_anchors(data)
    whole = np.flatnonzero(np.arange(WINDOW, len(data) + 1) <= np.repeat(ends, sizes)[: len(names)])
    first, count = runs_of(places[whole])  # texts have no place in common
    start = whole[first]
    content = Rolling(_LETTER[data]).stretch(start, start + count - 1 + WINDOW)
    text = np.searchsorted(ends, start, side="right")
    begin = (ends - sizes)[text]
    return numbers[text], names[start].view(np.int64), content, start - begin, count, places[start] - begin


def values(text: str) -> np.ndarray:
    return _LETTER[np.frombuffer(text.encode(), np.uint8)]


def without_spans(text: str, spans: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    """Number of bytes, of removed bytes and of removed runs, and the digest of the bytes that are kept."""
    data = text.encode()
    found = merged_spans(spans, len(data))
    kept, at = [], 0
    for start, end in found:
        kept.append(data[at:start])
        at = end
    rest = b"".join([*kept, data[at:]])
    return len(data), len(data) - len(rest), len(found), hashlib.sha256(rest).hexdigest()


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removed is each byte of a string of 100 bytes that also starts earlier: in a document with a smaller doc_id, or
    in the same one at a smaller place. A null text is empty; a null doc_id is the smallest. Rows with one
    doc_id count as one document: their spans are shared and cut to each text.
    """
    rows = docs.select(id_column().alias("doc_id"), whole_text().alias("text"))
    spans = earlier_windows(rows, runs, values, WINDOW, within=True, block=12, store=False)
    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    found = map_spans(rows, spans, without_spans, schema)
    return found.select(id_back(), "n_bytes", "n_removed", "n_spans", "kept_sha256")
