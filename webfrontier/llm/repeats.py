"""Which windows of a text also start earlier in the corpus, told from anchors that equal windows share.

Both substring operators cut the windows of a document into runs of neighbours that have the same anchor, a place
picked by the content of the window alone. Equal windows then have equal anchors (``key``), and runs with equal
content (``content``) have the same windows. So most work is done on runs and on blocks of them: windows are looked at one by one only
where one anchor, and one middle part of a block, has different content around it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webfrontier.llm.common import map_texts, settled, ship, whole_text, written
from webfrontier.llm.shingles import mixed

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray) -> None:
        count = len(values) + 1
        if len(_POWERS[0]) < count:
            size = 1 << count.bit_length()
            for at, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                _POWERS[at] = np.cumprod(factors)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _POWERS[0][: len(values)], dtype=np.uint64)])

    def stretch(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        whole = (self.sums[end] - self.sums[first]) * _POWERS[1][first]
        return mixed(whole + (end - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def runs_of(*anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of every run of neighbours that are equal in all of ``anchors``."""
    fresh = np.any([x[1:] != x[:-1] for x in anchors], axis=0)
    first = np.flatnonzero(np.concatenate([[True], fresh]))
    return first, np.diff(np.append(first, len(anchors[0])))


def shared_rows(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key occurs in two or more rows.

    Keys are counted with a map-side sum. The table of those that repeat is written, so the join has a plain exchange on
    both sides and adaptive execution can split a key that a third of all rows have.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return rows.join(settled(counts.select(key), "shared-keys"), key)


def with_first(rows: DataFrame, key: list[str], value: Column, how: str = "left") -> DataFrame:
    """The rows with ``first``, the smallest value of their key, joined as in shared_rows; a key of one row has none."""
    firsts = rows.groupBy(*key).agg(F.min(value).alias("first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return rows.join(settled(firsts.drop("_n"), "firsts"), key, how)


def _folded(rows: DataFrame, place: Column) -> tuple[DataFrame, DataFrame]:
    """Of rows (doc_id, key, content, start, n, at): those whose content starts earlier too, and those to be looked at closer.

    Rows of a key that occurs once, and first rows of a key with one content only, have no window that others have.
    """
    shared = settled(shared_rows(rows, "key"), "shared-runs")
    shared = settled(with_first(shared, ["key", "content"], place), "first-runs")
    firsts = shared.filter(F.col("first").isNull() | (place == F.col("first")))
    kinds = firsts.groupBy("key").agg(F.min("content").alias("_a"), F.max("content").alias("_b")).filter("_a != _b")
    closer = firsts.join(settled(kinds.select("key"), "mixed-keys"), "key", "left_semi")
    return shared.filter(place != F.col("first")), closer


def earlier_windows(
    docs: DataFrame, runs: Callable, values: Callable, width: int, within: bool, block: int, store: bool
) -> DataFrame:
    """(doc_id, spans) of documents with windows that also start earlier; spans are arrays of (start, end) of such windows.

    ``runs(texts)`` gives the arrays text number, key, content, start, count and anchor place of the runs of some texts,
    ``values(text)`` the 64-bit values that windows are made of. Runs are folded first. What is left of them is cut
    into blocks of ``block`` windows, counted from the anchor, and a block is known by what all its windows have
    in common, so a block around a changed place drops out as a whole. Blocks are folded like runs,
    and only what is left of them is looked at window by window. Equal windows have equal anchors and so lie in
    blocks of one key. Earlier means in a document of smaller doc_id and, if ``within``, also at a smaller start of
    the same one. ``docs`` has doc_id (not null) and text. Windows are compared by 64-bit hashes of their whole
    content. Runs are read twice; ``store`` writes them in between, otherwise they are made anew, which pays where they
    are quickly made and many.
    """
    ship(docs.sparkSession)
    names = ["doc_id", "key", "content", "start", "n", "at"]
    schema = "doc_id long, key long, content long, start int, n int, at int"

    def batch_of(ids, key, content, start, count, at) -> pa.RecordBatch:
        small = [x.astype(np.int32) for x in (start, count, at)]
        return pa.RecordBatch.from_arrays([*map(pa.array, (ids, key, content, *small))], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                ids = np.array(part.column(0).to_pylist(), np.int64)
                number, *columns = runs(part.column(1).to_pylist())
                yield batch_of(ids[number], *columns)

    def read(rows: DataFrame) -> DataFrame:
        """The texts that the rows lie in, each with its rows."""
        own = rows.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "at")).alias("runs"))
        return docs.select("doc_id", whole_text().alias("text")).join(own, "doc_id")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Rolling, np.ndarray, np.ndarray]]:
        """Id, values, and start and anchor of every window of a text's rows."""
        for batch in batches:
            bounds, (start, n, at) = list_items(batch.column(2))
            for row in range(batch.num_rows):
                doc_id, text = (batch.column(k)[row].as_py() for k in range(2))
                own = slice(bounds[row], bounds[row + 1])
                count = n[own]
                inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                yield doc_id, Rolling(values(text)), np.repeat(start[own], count) + inside, np.repeat(at[own], count)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, text, window, at in parts(batches):
            number = np.floor_divide(window - at, block)
            fresh = np.concatenate([[True], (np.diff(window) != 1) | (np.diff(at) != 0) | (np.diff(number) != 0)])
            begin = np.flatnonzero(fresh)
            count = np.diff(np.append(begin, len(window)))
            start, at, number = window[begin], at[begin], number[begin]
            common = text.stretch(at + number * block + block - 1, at + number * block + width)
            key = mixed(common.view(np.uint64) + number.astype(np.uint64)).view(np.int64)
            content = text.stretch(start, start + count - 1 + width)
            yield batch_of(np.full(len(start), doc_id, np.int64), key, content, start, count, at)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, text, window, _ in parts(batches):
            data = (np.full(len(window), doc_id, np.int64), text.stretch(window, window + width), window.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*map(pa.array, data)], names=["doc_id", "window", "start"])

    place = F.struct("doc_id", "start") if within else F.col("doc_id")
    rows = map_texts(docs, cut, schema)
    copied, left = _folded(written(rows, "runs") if store else rows, place)
    del rows
    again, left = _folded(settled(read(left).mapInArrow(blocks, schema), "blocks"), place)
    single = settled(read(left).mapInArrow(windows, "doc_id long, window long, start int"), "windows")
    del left
    later = with_first(single, ["window"], place, "inner").filter(place != F.col("first")).withColumn("n", F.lit(1))
    spans = copied.select("doc_id", "start", "n")
    for more in (again, later):
        spans = spans.unionByName(more.select("doc_id", "start", "n"))
    ends = F.struct("start", (F.col("start") + F.col("n") - 1 + width).alias("end"))
    return settled(spans.groupBy("doc_id").agg(F.collect_list(ends).alias("spans")), "spans")


def list_items(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where the items of every row's list of structs begin and end, and the fields of all items as 64-bit numbers."""
    return column.offsets.to_numpy(), [x.to_numpy().astype(np.int64) for x in column.values.flatten()]


def touching(rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (row, start, end) with those of a row that overlap or touch made one, in order of row and start."""
    low, high = (rows << 32) + start, (rows << 32) + end
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    fresh = np.flatnonzero(low[1:] > high[:-1]) + 1
    low, high = low[np.append(0, fresh)[: len(low)]], high[np.append(fresh, len(high))[: len(low)] - 1]
    return low >> 32, low & 0xFFFFFFFF, high & 0xFFFFFFFF


def merged_spans(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Maximal runs that the spans cover, cut to the size of the text."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        end = min(end, size)
        if start >= end:
            continue
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def map_spans(docs: DataFrame, spans: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``function(text, spans)`` of every document, with the spans found for it or none; ``schema`` names its results."""
    names = ["doc_id", *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found, spans = [], [[] for _ in range(part.num_rows)]
                bounds, (start, end) = list_items(part.column(2))
                items = slice(bounds[0], bounds[-1])
                rows = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                for row, *span in zip(*(x.tolist() for x in touching(rows, start[items], end[items]))):
                    spans[row].append(tuple(span))
                for text, own in zip(part.column(1).to_pylist(), spans):
                    found.append(function(text, own))
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, zip(*found))], names=names)

    joined = docs.join(spans, "doc_id", "left").select("doc_id", whole_text().alias("text"), "spans")
    return joined.mapInArrow(run, f"doc_id long, {schema}")
