"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webfrontier.llm.common import map_texts, ship, texts, written
from webfrontier.llm.word_tokens import chunk_encoder

#: Bins of a bucket are numbered in so many bits, so a bucket must not have more pieces.
BIN_BITS = 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Search:
    """How hard to search. ``bucket`` pieces are packed together on ``islands`` populations of ``population`` plans,
    which take ``generations`` steps between ``epochs`` that begin with the neighbour's best plan. Sequences filled
    below ``well_filled`` are dealt anew, together with those of other buckets."""

    bucket: int = 4000
    islands: int = 2
    epochs: int = 2
    generations: int = 12
    population: int = 4
    well_filled: float = 0.995

    def __post_init__(self) -> None:
        if self.bucket > 1 << (BIN_BITS - 1):
            raise ValueError("a bucket holds at most 32768 pieces")


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """PIECES of every row: its ids with ``end_id`` behind, cut every ``capacity`` ids. A null text has the end id only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(tokenizer)
        end = np.array([end_id], np.uint32)
        for ids, group in texts(batches):
            rows = []
            for doc_id, text in zip(ids, group):
                found = np.concatenate([encoder.ids(text), end]).astype("<u4")
                for piece, start in enumerate(range(0, len(found), capacity)):
                    part = found[start : start + capacity]
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PIECES.split(", ")])

    return map_texts(docs, run, PIECES)


def best_fit(order: np.ndarray, lengths: np.ndarray, room: list[int], bins: np.ndarray, capacity: int) -> None:
    """Puts the items in ``order`` one by one where the least room is left, writing their bins; opens bins as needed."""
    by_room: dict[int, list[int]] = {}
    open_rooms = 0  # a bit for every room that some bin has
    for number, left in enumerate(room):
        if left:
            by_room.setdefault(left, []).append(number)
            open_rooms |= 1 << left
    for item, need in zip(order.tolist(), lengths[order].tolist()):
        wide = open_rooms >> need
        if wide:
            left = need + (wide & -wide).bit_length() - 1
            same = by_room[left]
            number = same.pop()
            if not same:
                open_rooms ^= 1 << left
        else:
            left, number = capacity, len(room)
            room.append(capacity)
        bins[item] = number
        left -= need
        room[number] = left
        if left:
            by_room.setdefault(left, []).append(number)
            open_rooms |= 1 << left


def fitness(plan: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Larger is better: fewer bins first, then fuller ones."""
    fill = np.bincount(plan, lengths) / capacity
    return -len(fill), float((fill**2).sum())


def cross(taker: np.ndarray, giver: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child: well-filled bins of the giver go in whole, the taker's bins that held their items go, as do its
    emptiest ones, and the items displaced by that are best-fitted into what is left."""
    full = np.flatnonzero(np.bincount(giver, lengths) >= 0.99 * capacity)
    given = np.zeros(giver.max() + 1, bool)
    given[full[rng.random(len(full)) < 0.2]] = True
    injected = given[giver]
    fill = np.bincount(taker, lengths)
    lost = np.zeros(len(fill), bool)
    lost[taker[injected]] = True
    lost[np.argsort(fill)[: 1 + len(fill) // 50]] = True
    displaced = np.flatnonzero(lost[taker] & ~injected)
    child = np.where(injected, giver + len(fill), np.where(lost[taker], -1, taker))
    kept, numbers = np.unique(child[child >= 0], return_inverse=True)
    child[child >= 0] = numbers
    room = (capacity - np.bincount(numbers, lengths[child >= 0], minlength=len(kept))).astype(int).tolist()
    best_fit(displaced[np.argsort(-lengths[displaced], kind="stable")], lengths, room, child, capacity)
    return child


def evolve(lengths: np.ndarray, plans: list[np.ndarray], capacity: int, search: Search, seed: int) -> list[np.ndarray]:
    """The island's population after some generations, best first; it stops where a plan meets the lower bound."""
    rng = np.random.default_rng(seed)
    plans = list(plans)
    while len(plans) < search.population:
        blur = 1 + 0.15 * rng.random(len(lengths)) * (len(plans) > 0)
        plan = np.zeros(len(lengths), np.int64)
        best_fit(np.argsort(-lengths * blur, kind="stable"), lengths, [], plan, capacity)
        plans.append(plan)
    least = -(-int(lengths.sum()) // capacity)
    ranked = sorted(((fitness(p, lengths, capacity), n, p) for n, p in enumerate(plans)), key=lambda x: x[:2], reverse=True)
    ranked = ranked[: search.population]
    for step in range(search.generations):
        if -ranked[0][0][0] <= least:
            break
        a, b = rng.choice(len(ranked), 2, replace=False)
        child = cross(ranked[a][2], ranked[b][2], lengths, capacity, rng)
        ranked.append((fitness(child, lengths, capacity), len(plans) + step, child))
        ranked = sorted(ranked, key=lambda x: x[:2], reverse=True)[: search.population]
    return [x[2] for x in ranked]


def _pack_round(pieces: DataFrame, buckets: int, number: int, capacity: int, search: Search) -> DataFrame:
    """The best plan of every bucket: bucket, piece_no, length, bin, fill (of the bin)."""

    def step(epoch: int):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["piece_no", "elite"], kind="stable")
            own, guests = rows[~rows["elite"]], rows[rows["elite"]]
            lengths = own["length"].to_numpy()
            plans = [np.array(p, np.int64) for side in (own, guests) for p in zip(*side["plans"])]
            seed = [int(x) & 0x7FFFFFFF for x in key] + [number, epoch]
            found = evolve(lengths, plans, capacity, search, seed)
            bins, fill = fitness(found[0], lengths, capacity)
            return own.assign(plans=list(np.stack(found, 1).tolist()), score=bins * 1e6 + fill)[
                ["bucket", "island", "piece_no", "length", "plans", "score"]
            ]

        return run

    schema = "bucket long, island int, piece_no long, length long, plans array<int>, score double"
    state = pieces.select(
        F.pmod(F.xxhash64("piece_no", F.lit(number)), F.lit(buckets)).alias("bucket"),
        F.explode(F.array(*map(F.lit, range(search.islands)))).alias("island"),
        "piece_no",
        "length",
        F.array().cast("array<int>").alias("plans"),
        F.lit(False).alias("elite"),
    )
    for epoch in range(search.epochs):
        state = written(state.groupBy("bucket", "island").applyInPandas(step(epoch), schema), "island-plans")
        if epoch + 1 < search.epochs:
            guests = state.select(
                "bucket",
                F.pmod(F.col("island") + 1, F.lit(search.islands)).alias("island"),
                "piece_no",
                "length",
                F.slice("plans", 1, 1).alias("plans"),
                F.lit(True).alias("elite"),
            )
            own = state.select("bucket", "island", "piece_no", "length", "plans", F.lit(False).alias("elite"))
            state = own.unionByName(guests)
    best = state.groupBy("bucket").agg(F.max_by("island", F.struct("score", "island")).alias("island"))
    chosen = state.join(best, ["bucket", "island"]).withColumn("bin", F.col("plans")[0])
    fill = F.sum("length").over(Window.partitionBy("bucket", "bin"))
    return chosen.select("bucket", "piece_no", "length", "bin", fill.alias("fill"))


def pack(pieces: DataFrame, capacity: int, search: Search | None = None) -> DataFrame:
    """PIECES with sequence_id and offset, every sequence at most ``capacity`` long and without gaps.

    Pieces as long as a sequence stand alone. The others are dealt to buckets by hash; sequences that a bucket fills
    well are final, and the pieces of the rest are packed again in fewer buckets, until one bucket has taken in all
    that is left. After a round that settles less than half of its pieces, a bucket keeps only its least filled sequence open: the pieces of
    the others have found no place in it, nor its pieces in them. Such rounds at least halve the buckets, and what a bucket hands on is
    shorter than one sequence. Only the last bucket can leave a sequence half empty for want of pieces. An empty table gives no sequences; rows may repeat.
    """
    search = search or Search()
    ship(pieces.sparkSession)
    numbered = written(pieces.withColumn("piece_no", F.monotonically_increasing_id()), "pieces")
    placed = numbered.filter(F.col("length") >= capacity).select("piece_no", F.col("piece_no").alias("sequence_id"))
    left = numbered.filter(F.col("length") < capacity).select("piece_no", "length")
    count, number, slow, buckets = left.count(), 0, False, 0
    while count:
        dealt = -(-count // search.bucket)
        buckets = max(1, min(dealt, buckets // 2)) if slow else dealt
        found = _pack_round(left, buckets, number, capacity, search)
        code = F.shiftleft(F.lit(number).cast("long"), 56) + F.shiftleft(F.col("bucket"), BIN_BITS) + F.col("bin")
        final = F.lit(True) if buckets == 1 else F.col("fill") >= search.well_filled * capacity
        if slow:
            least = F.min(F.struct("fill", "bin")).over(Window.partitionBy("bucket"))
            found = found.withColumn("least", least["bin"])
            final = final | (F.col("bin") != F.col("least"))
        found = found.withColumn("final", final).withColumn("sequence_id", -1 - code)
        found = written(found, "packed-bins")
        rest = found.filter("NOT final").count()
        placed = placed.unionByName(found.filter("final").select("piece_no", "sequence_id"))
        left = found.filter(~F.col("final")).select("piece_no", "length")
        slow, count, number = rest * 2 > count, rest, number + 1
    order = Window.partitionBy("sequence_id").orderBy("piece_no").rowsBetween(Window.unboundedPreceding, -1)
    return numbered.join(placed, "piece_no").select(
        *[x.split()[0] for x in PIECES.split(", ")],
        "sequence_id",
        F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset"),
    )
