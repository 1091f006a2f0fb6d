"""N-gram Jaccard join: the components of documents whose sets of five-word shingles are similar.

Only the part of the matrix of documents by shingles that can tell similar documents apart is looked at: the rarest
columns of each row. Pairs that share too few of them by their sizes are discarded, the others checked on whole sets. Links
that can't change a component are not looked for here: ``shingle_product`` finds them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webfrontier.llm.common import NO_ID, free_name, id_back, id_column, map_texts, settled, ship, texts, whole_text, written
from webfrontier.llm.components import connected
from webfrontier.llm.shingles import shingle_set

#: Columns are counted in so many buckets to put frequent ones last. The counts only order the columns.
_BUCKET_BITS, _BLOCK = 24, 1 << 15
#: A pair is not met again in a column if it shares one of so many before it.
_LOOK_BACK = 4
#: Words of 64 bits that tell whole sets apart before they are compared.
_MASK_WORDS = 16
#: Rounds that compare with one leader per column, before all that is left is multiplied out.
_LEADER_ROUNDS = 4
#: Pairs for each row of the first round that may be left to multiply out.
_OPEN_PAIRS = 4
#: Ids of nodes that are broadcast at most, 16 MB of them, to leave the rows of all others where they lie.
_FEW_NODES = 2_000_000
#: Rows with one node's numbers that are broadcast at most, some 30 MB of them, to leave the cells by their columns.
_FEW_ROWS = 500_000


def needed_columns(n: Column | int):
    """How many of the rarest columns two similar documents must share, by the smaller one's size (see _prefix)."""
    return (F.floor(n / 40) + 1).cast("int") if isinstance(n, Column) else n // 40 + 1


def _prefix(n: int) -> int:
    """With a similarity of 0.8 two sets share 0.8 of the larger one, so among their first
    n - ceil(0.8 n) + k columns in a common order they share k."""
    return min(n, n - -(-8 * n // 10) + needed_columns(n))


def _behind_prefix(n: Column) -> Column:
    """How many columns of a set of n are not among its rarest."""
    return n - F.least(n, n - F.floor((8 * n + 9) / 10) + needed_columns(n))


def _column_frequencies(docs: DataFrame) -> np.ndarray:
    """Logarithm of the frequency of each bucket: 2**_BUCKET_BITS bytes, whatever the input.

    A task counts all its columns; the counts of all tasks are added up block by block, however the documents are dealt.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << _BUCKET_BITS, np.uint8)
        held, size = [], 0

        def add() -> None:
            buckets, n = np.unique(np.concatenate(held), return_counts=True)
            total[buckets] = np.minimum(total[buckets] + n, 255)

        for _, group in texts(batches):
            for text in group:
                held.append((shingle_set(text) >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64))
                size += len(held[-1])
            if size > 1 << 20:
                add()
                held, size = [], 0
        if held:
            add()
        blocks = total.reshape(-1, _BLOCK)
        pack = zstandard.ZstdCompressor(level=1)
        for block in np.flatnonzero(blocks.any(axis=1)):
            data = [pa.array([block], pa.int32()), pa.array([pack.compress(blocks[block].tobytes())], pa.binary())]
            yield pa.RecordBatch.from_arrays(data, names=["block", "counts"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, unpack = {}, zstandard.ZstdDecompressor()
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total = totals.setdefault(block, np.zeros(_BLOCK, np.uint32))
                total += np.frombuffer(unpack.decompress(counts), np.uint8)
        pack = zstandard.ZstdCompressor(level=1)
        for block, total in totals.items():
            logs = np.ceil(np.log2(total + 1.0)).astype(np.uint8)
            data = [pa.array([block], pa.int32()), pa.array([pack.compress(logs.tobytes())], pa.binary())]
            yield pa.RecordBatch.from_arrays(data, names=["block", "logs"])

    blocks = map_texts(docs, count, "block int, counts binary").repartition("block")
    table, unpack = np.zeros(1 << _BUCKET_BITS, np.uint8), zstandard.ZstdDecompressor()
    for row in blocks.mapInArrow(add_up, "block int, logs binary").toLocalIterator():
        table[row["block"] * _BLOCK :][:_BLOCK] = np.frombuffer(unpack.decompress(bytes(row["logs"])), np.uint8)
    return table


def set_key(shingles: np.ndarray) -> bytes:
    """Equal for equal sets."""
    return hashlib.sha256(shingles.tobytes()).digest()[:16]


def _mask(shingles: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * _MASK_WORDS, np.uint8)
    bits[(shingles >> np.uint64(20)).astype(np.int64) % len(bits)] = 1
    return np.packbits(bits).view(np.int64)


def _beside_mask(mask: str, n: str) -> Column:
    """How many columns of a node share their bits with its others."""
    return F.expr(f"{n} - ({' + '.join(f'bit_count({mask}[{i}])' for i in range(_MASK_WORDS))})").cast("int")


def _alike(a: str, b: str) -> Column:
    """Whether two nodes can be similar by their masks: each bit that only one has stands for a column that only it has.

    So of n columns it shares all but its bits that the other one lacks: the common bits, and ``beside`` (_beside_mask). Written
    so, the test stays small enough for the JVM to compile the loop over the pairs of a column; a loop of over
    8000 bytes it interprets.
    """
    common = F.expr(" + ".join(f"bit_count({a}.mask[{i}] & {b}.mask[{i}])" for i in range(_MASK_WORDS)))
    return 9 * (common + F.least(f"{a}.beside", f"{b}.beside")) >= 4 * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def incidence(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, set_key (equal for equal sets), n, node, columns (the rarest ones, in order), end (the place of the
    last of them in the common order), mask (a bit for each value of the first bits of its columns).

    Of documents with equal sets only the first of a task is a node and has columns, the others are found by their key.
    """
    frequencies = docs.sparkSession.sparkContext.broadcast(_column_frequencies(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, table = set(), frequencies.value
        for ids, group in texts(batches):
            keys, sizes, nodes, columns, ends, masks = [], [], [], [], [], []
            for text in group:
                found = shingle_set(text)
                key = set_key(found)
                keys.append(key)
                sizes.append(len(found))
                nodes.append(key not in seen and len(found) > 0)
                if not nodes[-1]:
                    columns.append([])
                    ends.append(None)
                    masks.append(None)
                    continue
                seen.add(key)
                logs = table[found >> np.uint64(64 - _BUCKET_BITS)]
                order = np.lexsort((found, logs))[: _prefix(len(found))]
                columns.append(found[order].view(np.int64))
                ends.append(int(logs[order[-1]]) << 57 | int(found[order[-1]]) >> 7)
                masks.append(_mask(found))
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64())]
            data = [pa.array(x, k) for x, k in zip((ids, keys, sizes, nodes, columns, ends, masks), kinds)]
            yield pa.RecordBatch.from_arrays(data, names=["doc_id", "set_key", "n", "node", "columns", "end", "mask"])

    plain = docs.select(id_column().alias("doc_id"), "text")
    schema = "doc_id long, set_key binary, n int, node boolean, columns array<long>, end long, mask array<long>"
    return written(map_texts(plain, run, schema), "shingle-columns")


def _with_nodes(cells: DataFrame, nodes: DataFrame, how: str = "inner") -> DataFrame:
    """The cells with what ``nodes``, a written table, has of their nodes.

    Cells lie by their columns. As long as few rows are broadcast they stay so, and what is grouped by column meets before its exchange.
    """
    return cells.join(F.broadcast(nodes) if nodes.count() <= _FEW_ROWS else nodes, "node", how)


def _shared_columns(table: DataFrame) -> DataFrame:
    """(column, node, place, n, most, end) of the columns that two or more nodes have, for nodes that share enough of theirs.

    ``place`` is that of the column in the node's order. ``most`` is what a node can share with another whose columns end later: all but those of its columns that no other node has.

    Most columns belong to one document. Their rows stay narrow, and the table of shared columns is written, so
    the join has a plain exchange on both sides and adaptive execution can split a frequent column.
    """
    rows = table.filter("node").select(F.col("doc_id").alias("node"), F.posexplode("columns").alias("place", "column"))
    counts = rows.groupBy("column").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1")
    shared = settled(rows.join(settled(counts.select("column"), "shared-columns"), "column"), "shared-cells")
    sizes = table.filter("node").select(F.col("doc_id").alias("node"), "n", F.size("columns").alias("_p"), "end")
    rich = shared.groupBy("node").agg(F.count(F.lit(1)).alias("_k")).join(sizes, "node")
    partner = needed_columns(F.floor(F.col("n") * 4 / 5))  # the smallest partner asks for no less
    most = (F.col("n") - F.col("_p") + F.col("_k")).cast("int").alias("most")
    rich = written(rich.filter(F.col("_k") >= partner).select("node", "n", most, "end"), "rich-nodes")
    return _with_nodes(shared, rich).select("column", "node", "place", "n", "most", "end")


def _open_cells(shared: DataFrame) -> DataFrame:
    """The rows of ``shared`` in columns that nodes of different components have, for nodes that have enough of these columns.

    Similar nodes of different components share no other columns. So the rest can't link anything any more, and ``most`` counts
    only these columns from now on.
    """
    kinds = shared.groupBy("column").agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
    open_ = written(kinds.filter("_low != _high").select("column"), "open-columns")
    cells = settled(shared.join(open_, "column", "left_semi"), "open-cells")
    rich = cells.groupBy("node", "n").agg(F.count(F.lit(1)).alias("_k"))
    rich = rich.filter(F.col("_k") >= needed_columns(F.floor(F.col("n") * 4 / 5)))
    rich = written(rich.select("node", (_behind_prefix(F.col("n")) + F.col("_k")).cast("int").alias("most")), "open-nodes")
    return settled(_with_nodes(cells.drop("most"), rich), "open-rich-cells")


def _close(a: str, b: str) -> Column:
    """Whether two nodes can be similar by their sizes and by what each can share at all.

    Of two documents, the one whose rarest columns end first in the common order has nothing of the other one beyond what both
    have among these columns: a column of the other one in its range would be among the other's rarest, too.
    """
    n_a, n_b, end_a, end_b = (F.col(x) for x in (f"{a}.n", f"{b}.n", f"{a}.end", f"{b}.end"))
    most_a, most_b = F.col(f"{a}.most"), F.col(f"{b}.most")
    most = F.when(end_a < end_b, most_a).when(end_b < end_a, most_b).otherwise(F.greatest(most_a, most_b))
    return (5 * n_a >= 4 * n_b) & (5 * n_b >= 4 * n_a) & (9 * most >= 4 * (n_a + n_b))


def _bounded(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, k) that can be similar: by their sizes, and by the number k of columns they were found to share."""
    smaller, larger = F.least("na", "nb"), F.greatest("na", "nb")
    pairs = pairs.filter(5 * smaller >= 4 * larger)
    return possible(pairs.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("k"))).select("a", "b", "k")


def possible(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb, k) that can be similar.

    Of two documents, the one whose rarest columns end first in the common order shares those with the other one
    only among the other's rarest columns. So both share at most k and what it has besides.
    """
    smaller = F.least("na", "nb")
    rest = F.greatest(*map(_behind_prefix, map(F.col, ("na", "nb"))))
    enough = (F.col("k") >= needed_columns(smaller)) & (9 * (F.col("k") + rest) >= 4 * (F.col("na") + F.col("nb")))
    return pairs.filter(enough)


def _of_pairs(rows: DataFrame, name: str, pairs: DataFrame) -> DataFrame:
    """The rows whose node is in ``pairs``, a written table; all rows where these are too many nodes to be broadcast.

    Rows with columns or whole sets are long, and pairs name few of them, so others are dropped before the exchange.
    """
    nodes = pairs.select(F.explode(F.array("a", "b")).alias(name)).distinct()
    return rows.join(F.broadcast(nodes), name, "left_semi") if nodes.count() <= _FEW_NODES else rows


def _counted(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Pairs (a, b, k) of a written table (a, b, na, nb) that can be similar, k counted on the rarest columns of both."""
    own = _of_pairs(table.filter("node").select("doc_id", "columns"), "doc_id", pairs)
    for name in ("a", "b"):
        pairs = pairs.join(own.select(F.col("doc_id").alias(name), F.col("columns").alias(f"_{name}")), name)
    shared = F.size(F.array_intersect("_a", "_b")).alias("k")
    return possible(pairs.select("a", "b", "na", "nb", shared)).select("a", "b", "k")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of a written table whose whole sets are similar."""
    sets = _of_pairs(sets, "node", pairs)
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                marks.append(9 * shared >= 4 * (len(p) + len(q)))
            yield batch.select([0, 1]).filter(pa.array(marks, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "_a", "_b").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Whole shingle sets of the nodes, a written table, as sorted bytes. Few enough ids are broadcast, so texts stay where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, group in texts(batches):
            data = [pa.array(ids, pa.int64()), pa.array([shingle_set(x).tobytes() for x in group], pa.binary())]
            yield pa.RecordBatch.from_arrays(data, names=["node", "shingles"])

    few = F.broadcast(nodes) if nodes.count() <= _FEW_NODES else nodes
    plain = docs.select(id_column().alias("node"), whole_text().alias("text")).join(few, "node", "left_semi")
    return settled(plain.mapInArrow(run, "node long, shingles binary"), "shingle-sets")


def _with_components(shared: DataFrame, links: DataFrame) -> DataFrame:
    labelled = _with_nodes(shared.drop("component"), connected(links), "left")
    return settled(labelled.withColumn("component", F.coalesce("component", "node")), "labelled-cells")


def _open_pairs(shared: DataFrame) -> int:
    """Pairs of rows of a column that lie in different components, from counts alone."""
    counts = shared.groupBy("column", "component").agg(F.count(F.lit(1)).alias("m"))
    columns = counts.groupBy("column").agg(((F.sum("m") ** 2 - F.sum(F.col("m") ** 2)) / 2).alias("pairs"))
    return int(columns.agg(F.sum("pairs")).first()[0] or 0)


def _met(cells: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb) of cells of a column whose nodes lie in different components and can be similar."""
    other = F.expr("x.column = y.column AND x.node < y.node AND x.component != y.component")
    # A pair that shares a column just before this one was met there already, or before.
    once = F.expr("NOT arrays_overlap(x.behind, y.behind)")
    met = cells.alias("x").join(cells.alias("y"), other & _close("x", "y") & _alike("x", "y") & once)
    return met.selectExpr("x.node AS a", "y.node AS b", "x.n AS na", "y.n AS nb")


def similar_links(docs: DataFrame, table: DataFrame) -> DataFrame:
    """Links (a, b) between nodes that join all similar documents: not every pair, but every component.

    A column of one large group of near copies would give the square of its size in pairs. So each round first
    compares every node with one leader: each column has one, and of those of its columns a node takes the one with
    which it shares most. What is linked becomes one component. When few pairs of different components are left,
    after a round that links nothing, or after some rounds, all of these are multiplied out; pairs inside a component need no
    comparison, as they can't change it. After a round that found links, columns and nodes that have nothing left to tell are dropped.
    """
    shared = _shared_columns(table)
    # documents of equal sets met in different tasks are linked at once
    same = table.filter("node").select("set_key", F.col("doc_id").alias("a"))
    first = same.groupBy("set_key").agg(F.min("a").alias("b"))
    links = written(same.join(first, "set_key").filter("a != b").select("a", "b"), "equal-sets")
    shared = _with_components(shared, links)
    sets = _sets(docs, written(shared.select("node").distinct(), "shared-nodes"))
    rows, pruned = shared.count(), False
    for number in range(_LEADER_ROUNDS):
        if number and _open_pairs(shared) <= _OPEN_PAIRS * rows:
            break
        # First the leader that has least of its own, the middle of a group of near copies; later others by chance.
        own = F.lit(0.0) if number else 1 - F.col("most") / F.col("n")
        order = F.struct(own.alias("own"), F.xxhash64("node", F.lit(number)).alias("h"), "node", "n", "most", "end", "component")
        leaders = written(shared.groupBy("column").agg(F.min(order).alias("lead")), "leaders").select("column", "lead.*")
        met = shared.alias("x").join(leaders.alias("y"), F.expr("x.column = y.column AND x.component != y.component") & _close("x", "y"))
        pairs = met.selectExpr("x.node AS a", "y.node AS b", "x.n AS na", "y.n AS nb")
        best = written(_bounded(pairs.repartition("a")).groupBy("a").agg(F.max_by("b", F.struct("k", "b")).alias("b")), "best-leaders")
        more = settled(_similar(best, sets), "leader-links")
        if more.isEmpty():
            break
        links = links.union(more)
        shared, pruned = _open_cells(_with_components(shared, links)), True
    left = shared if pruned else _open_cells(shared)
    before = Window.partitionBy("node").orderBy("place").rowsBetween(-_LOOK_BACK, -1)
    masks = table.filter("node").select(F.col("doc_id").alias("node"), "mask", _beside_mask("mask", "n").alias("beside"))
    left = left.join(masks, "node")
    left = left.withColumn("behind", F.collect_list("column").over(before))
    met = written(_met(left).distinct(), "last-pairs")
    pairs = written(_counted(met, table), "counted-pairs")
    return links.union(settled(_similar(pairs, sets), "last-links"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Two documents are linked when their sets of five-word shingles have a Jaccard similarity of 0.8 or more; the
    component is the smallest doc_id that links lead to. Sets are compared by 64-bit hashes of shingles. Documents
    without words, and null texts, have no shingles and stand alone. A null doc_id counts as the smallest and
    comes out as null; repeated rows give repeated results.
    """
    ship(docs.sparkSession)
    table = incidence(docs)
    found = connected(similar_links(docs, table)).withColumnRenamed("node", "doc_id")
    # equal sets have one component, found by any node that has their columns
    base = table.select("doc_id", "set_key", "n", "node")
    own = F.when(F.col("node"), F.coalesce("component", "doc_id"))
    sets = base.filter("n > 0").join(found, "doc_id", "left").groupBy("set_key")
    sets = written(sets.agg(F.min(own).alias("_c"), F.min("doc_id").alias("_first")), "set-components")
    # a component's smallest document may be a copy without columns: its label is the smallest over its sets
    low = written(sets.groupBy("_c").agg(F.min("_first").alias("_low")), "smallest-documents")
    found = base.join(written(sets.join(low, "_c").select("set_key", "_low"), "set-labels"), "set_key", "left")
    label = F.when(F.col("n") > 0, F.col("_low")).otherwise(F.col("doc_id"))
    return found.select(
        id_back(),
        F.col("n").cast("long").alias("n_shingles"),
        F.when(label != NO_ID, label).alias("component_id"),
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest doc_id; of repeated rows one stays.

    Rows without a doc_id count as one document, and their different texts stay.
    """
    own, text = free_name(docs, "_own"), free_name(docs, "_hash")
    marks = near_duplicates(docs).filter("doc_id <=> component_id").select(id_column().alias(own)).distinct()
    tagged = docs.withColumn(own, id_column()).withColumn(text, F.xxhash64(whole_text()))
    return tagged.join(marks, own, "left_semi").dropDuplicates([own, text]).drop(own, text)
