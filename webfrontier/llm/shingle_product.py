"""All links of the n-gram join: every pair of different shingle sets whose similarity is 0.8 or more.

The sparse matrix of sets by their rarest columns is multiplied with itself in tiles: a block of columns and, where
columns are frequent, two groups of rows, so that no task holds a frequent column as a whole. Shared columns are
counted inside a tile, and one row per pair and tile travels instead of one per pair and column. The counts
are summed over tiles, pairs that can't be similar are discarded, and the rest is checked on whole sets, in tiles of two
groups of rows, so that a set travels once for all pairs of a tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webfrontier.llm.common import NO_ID, id_column, settled, ship, texts, whole_text, written
from webfrontier.llm.ngram_join import incidence, needed_columns, possible, set_key
from webfrontier.llm.shingles import shingle_set

#: Rows of a column that meet in one tile, cells of a tile, and sets of a group when whole sets are compared.
_ROWS = 128
_CELLS = 100_000
_GROUP = 1500
_HELD_PAIRS = 1 << 22
_PRODUCT = "a long, b long, na int, nb int, k long"
_CHECKED = "a long, b long, na int, nb int, n_shared long"


def _node() -> F.Column:
    """64 bits of the key of a set."""
    return F.conv(F.hex(F.substring("set_key", 1, 8)), 16, -10).cast("long")


def _cells(table: DataFrame) -> DataFrame:
    """(column, node, n, parts) of columns that several sets have, for sets that share enough of theirs.

    ``parts`` is the number of row groups of a column: 1, or a power of two if it has more than _ROWS rows.
    """
    rows = table.filter("node").select(_node().alias("node"), "n", F.explode("columns").alias("column"))
    counts = rows.groupBy("column").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1")
    parts = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("_k") / _ROWS, F.lit(1.0))))).cast("int")
    shared = settled(rows.join(settled(counts.select("column", parts.alias("parts")), "shared-columns"), "column"), "shared-cells")
    rich = shared.groupBy("node", "n").agg(F.count(F.lit(1)).alias("_k"))
    # the smallest partner asks for no less
    rich = rich.filter(F.col("_k") >= needed_columns(F.floor(F.col("n") * 4 / 5))).select("node")
    return settled(shared.join(written(rich, "rich-sets"), "node"), "rich-cells")


def _multiply(rows: pa.Table) -> pa.Table:
    """The pairs of a tile that can be similar by their sizes, with the number of columns they share in it."""
    node, column, n, part = (rows[x].to_numpy() for x in ("node", "column", "n", "part"))
    crossed = rows["low"][0].as_py() != rows["high"][0].as_py()
    names, at = np.unique(node, return_inverse=True)
    size, side = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    size[at], side[at] = n, part
    order = np.lexsort((at, column))
    column, at = column[order], at[order]
    fresh = np.concatenate([[True], (column[1:] != column[:-1]) | (at[1:] != at[:-1])])  # tasks may repeat a set
    column, at = column[fresh], at[fresh]
    codes, counts, waiting, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def summed() -> tuple[np.ndarray, np.ndarray]:
        new, times = np.unique(np.concatenate([np.zeros(0, np.int64), *waiting]), return_counts=True)
        both, place = np.unique(np.concatenate([codes, new]), return_inverse=True)
        return both, np.bincount(place, np.concatenate([counts, times]), len(both)).astype(np.int64)

    first, step = np.arange(len(column)), 0
    while True:
        step += 1
        first = first[first + step < len(column)]
        first = first[column[first] == column[first + step]]
        if not len(first):
            break
        a, b = at[first], at[first + step]
        fits = (5 * size[a] >= 4 * size[b]) & (5 * size[b] >= 4 * size[a])
        if crossed:
            fits &= side[a] != side[b]
        waiting.append(a[fits] * len(names) + b[fits])
        held += int(fits.sum())
        if held > _HELD_PAIRS:
            codes, counts = summed()
            waiting, held = [], 0
    codes, counts = summed()
    a, b = np.divmod(codes, max(len(names), 1))
    data = [pa.array(names[a]), pa.array(names[b]), *(pa.array(size[x].astype(np.int32)) for x in (a, b)), pa.array(counts)]
    return pa.Table.from_arrays(data, names=[x.split()[0] for x in _PRODUCT.split(", ")])


def _product(cells: DataFrame) -> DataFrame:
    """_PRODUCT of all pairs that share one of the columns: the tiles' counts, summed."""
    sizes = {row["parts"]: row["count"] for row in cells.groupBy("parts").count().collect()}
    blocks = F.lit(1)
    for parts, count in sizes.items():
        inside = count if parts == 1 else 2 * count / parts  # cells of a tile, were there one block
        blocks = F.when(F.col("parts") == parts, int(-(-inside // _CELLS))).otherwise(blocks)
    own = cells.withColumn("block", F.pmod(F.xxhash64("column"), blocks)).withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("other")
    met = own.select("column", "node", "n", "parts", "block", F.col("part").cast("long").alias("part"), other)
    met = met.select(
        "column", "node", "n", "part", "parts", "block", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")
    )
    tiles = met.groupBy("parts", "block", "low", "high").applyInArrow(_multiply, _PRODUCT)
    return settled(tiles, "tile-counts").groupBy("a", "b", "na", "nb").agg(F.sum("k").alias("k"))


def _check(key: tuple, pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """The pairs of a tile whose whole sets are similar, with the number of shingles they share."""
    whole = [np.frombuffer(x.as_buffer(), np.uint64) for x in sets["shingles"].combine_chunks()]
    names = sets["node"].to_numpy()
    order = np.argsort(names)
    a, b = (order[np.searchsorted(names, pairs[x].to_numpy(), sorter=order)] for x in ("a", "b"))
    by_left = np.argsort(a, kind="stable")
    shared = np.zeros(len(a), np.int64)
    for rows in np.split(by_left, np.flatnonzero(np.diff(a[by_left])) + 1):
        left = whole[a[rows[0]]]
        for at in range(0, len(rows), 256):
            part = rows[at : at + 256]
            right = [whole[x] for x in b[part]]
            values = np.concatenate(right)
            place = np.minimum(np.searchsorted(left, values), len(left) - 1)
            starts = np.cumsum([0, *map(len, right[:-1])])
            shared[part] = np.add.reduceat((left[place] == values).astype(np.int64), starts)
    pairs = pairs.select(["a", "b", "na", "nb"]).append_column("n_shared", pa.array(shared))
    # shared / (na + nb - shared) >= 0.8
    total = pairs["na"].to_numpy().astype(np.int64) + pairs["nb"].to_numpy()
    return pairs.filter(pa.array(9 * shared >= 4 * total))


def _whole_sets(docs: DataFrame, table: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes, each made from one document that has the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in texts(batches):
            found = [shingle_set(x) for x in group]
            keys = [int.from_bytes(set_key(x)[:8], "big", signed=True) for x in found]
            data = [pa.array(keys, pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(data, names=["node", "shingles"])

    owners = table.filter("node").select(_node().alias("node"), "doc_id").join(nodes, "node", "left_semi")
    owners = written(owners.groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct(), "set-owners")
    plain = docs.select(id_column().alias("doc_id"), whole_text().alias("text")).join(owners, "doc_id", "left_semi")
    found = plain.mapInArrow(run, "node long, shingles binary").join(nodes, "node", "left_semi")
    return settled(found.groupBy("node").agg(F.first("shingles").alias("shingles")), "whole-sets")


def similar_sets(docs: DataFrame) -> DataFrame:
    """All links: doc_a, doc_b, n_a, n_b, n_shared, copies_a, copies_b of every two different sets of five-word
    shingles with a Jaccard similarity of 0.8 or more.

    Equal sets are one node: doc_a and doc_b are the smallest doc_id with the set, copies the number of rows that have it.
    doc_a is the smaller one. A row without words has no links; a null doc_id counts as the smallest. Rows that repeat a
    doc_id with other words are sets of their own, so a link may join a doc_id with itself.
    """
    ship(docs.sparkSession)
    table = incidence(docs)
    pairs = written(possible(_product(_cells(table))), "possible-pairs")
    nodes = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "possible-sets")
    sets = _whole_sets(docs, table, nodes)
    groups = max(1, -(-nodes.count() // _GROUP))

    def group(name: str) -> F.Column:
        return F.pmod(F.xxhash64(name, F.lit(1)), F.lit(groups))

    tiled = pairs.withColumns({"x": group("a"), "y": group("b")})
    needed = tiled.select("x", "y", F.col("a").alias("node")).union(tiled.select("x", "y", "b")).distinct()
    needed = written(needed, "tile-sets")
    left, right = tiled.groupBy("x", "y"), needed.join(sets, "node").groupBy("x", "y")
    links = settled(left.cogroup(right).applyInArrow(_check, _CHECKED), "links")
    members = table.filter("n > 0").select(_node().alias("node"), "doc_id").groupBy("node")
    members = members.agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies")).join(nodes, "node", "left_semi")
    members = written(members, "set-members")
    for side in "ab":
        own = members.select(F.col("node").alias(side), F.col("doc").alias(f"doc_{side}"), F.col("copies").alias(f"copies_{side}"))
        links = links.join(own, side)
    names = ["doc", "node", "n", "copies"]
    ends = [F.struct(*(F.col(c).cast("long").alias(x) for c, x in zip((f"doc_{s}", s, f"n{s}", f"copies_{s}"), names))) for s in "ab"]
    links = links.select("n_shared", F.least(*ends).alias("a"), F.greatest(*ends).alias("b"))
    doc = {x: F.when(F.col(f"{x}.doc") != NO_ID, F.col(f"{x}.doc")).alias(f"doc_{x}") for x in "ab"}
    return links.select(
        doc["a"], doc["b"], F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"), "n_shared",
        F.col("a.copies").alias("copies_a"), F.col("b.copies").alias("copies_b"),
    )
