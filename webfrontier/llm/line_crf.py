"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webfrontier.llm.common import map_texts, ship, texts, whole_text

#: Kinds of bytes that are counted in a line; bytes of no kind are small letters and the like.
KINDS = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b"#*$%&|<>{}[]~^_=+\\@/",
    b".,;:'\"()-",
    b"!?",
    bytes(range(128, 256)),
    b" \t\v\f\r",
)
_KIND = np.full(256, len(KINDS), np.uint8)
for _number, _bytes in enumerate(KINDS):
    _KIND[list(_bytes)] = _number
#: Base features: the share of every kind, length, number of words, their mean length, the share of different words
#: and of words that repeat the one before.
BASE = len(KINDS) + 5
_BINS = 8


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Base features of every line (one row each; an empty text has one empty line) and the lines' lengths in bytes."""
    lines = text.split("\n")
    data = np.frombuffer(text.encode() + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    lengths = np.diff(ends, prepend=-1) - 1
    kinds = _KIND[data]
    out = np.zeros((len(lines), BASE), np.float32)
    size = np.maximum(lengths, 1)
    for number in range(len(KINDS)):
        seen = np.cumsum(kinds == number)[ends]
        out[:, number] = np.diff(seen, prepend=0) / size
    words = [x.split() for x in lines]
    counts = np.array([len(x) for x in words])
    different = np.array([len(set(x)) for x in words])
    again = np.array([sum(map(eq, x, x[1:])) for x in words])
    out[:, -5] = np.log1p(lengths)
    out[:, -4] = np.log1p(counts)
    out[:, -3] = np.log1p(lengths / np.maximum(counts, 1))
    out[:, -2] = different / np.maximum(counts, 1)
    out[:, -1] = again / np.maximum(counts, 1)
    return out, lengths


@dataclass
class LineModel:
    """Weights of the field. ``cuts`` (features x cuts) bin the base features; ``steps`` are the log-weights of passing
    from one label to the next, bad before good."""

    cuts: np.ndarray
    weights: np.ndarray
    steps: np.ndarray

    @staticmethod
    def width() -> int:
        return 3 * BASE + BASE * _BINS + 3

    def expand(self, base: np.ndarray) -> np.ndarray:
        """What a line's label is scored by: its features and their bins, and the features of the lines around it."""
        before = np.vstack([np.zeros((1, BASE), np.float32), base[:-1]])
        behind = np.vstack([base[1:], np.zeros((1, BASE), np.float32)])
        bins = (base[:, :, None] > self.cuts[None]).reshape(len(base), -1)
        edges = np.zeros((len(base), 3), np.float32)
        edges[:, 0] = 1
        edges[0, 1] = edges[-1, 2] = 1
        return np.hstack([base, before, behind, bins, edges]).astype(np.float32)

    def good_lines(self, base: np.ndarray) -> np.ndarray:
        """Marginal probability of every line to be good, by the forward-backward algorithm."""
        score = np.clip(self.expand(base) @ self.weights, -30, 30)
        good = np.exp(score).tolist()
        (bb, bg), (gb, gg) = np.exp(self.steps).tolist()
        ahead, x, y = [], 1.0, 1.0
        for n, e in enumerate(good):
            x, y = (1.0, e) if n == 0 else (x * bb + y * gb, (x * bg + y * gg) * e)
            total = x + y
            x, y = x / total, y / total
            ahead.append((x, y))
        out, p, q = [0.0] * len(good), 1.0, 1.0
        for n in range(len(good) - 1, -1, -1):
            x, y = ahead[n]
            out[n] = y * q / (x * p + y * q)
            p, q = bb * p + bg * good[n] * q, gb * p + gg * good[n] * q
            total = p + q
            p, q = p / total, q / total
        return np.array(out)

    def score(self, text: str) -> float:
        """Mean probability of the lines, weighted by their length."""
        base, lengths = line_features(text)
        return float(np.average(self.good_lines(base), weights=lengths + 1.0))


def _expected(score: np.ndarray, real: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the lines (documents x lines) and expected label pairs, for documents of one padded batch."""
    emit = np.stack([np.zeros_like(score), score], -1)
    move = np.exp(steps)
    width = score.shape[1]
    fore = np.zeros_like(emit)
    back = np.ones_like(emit)
    local = np.exp(emit)
    now = local[:, 0]
    fore[:, 0] = now / now.sum(1, keepdims=True)
    for t in range(1, width):
        now = (fore[:, t - 1] @ move) * local[:, t]
        fore[:, t] = now / now.sum(1, keepdims=True)
    for t in range(width - 2, -1, -1):
        now = (local[:, t + 1] * back[:, t + 1]) @ move.T
        now = now / now.sum(1, keepdims=True)
        back[:, t] = np.where(real[:, t + 1, None], now, 1.0)
    both = fore * back
    marginal = (both / both.sum(-1, keepdims=True))[..., 1] * real
    pairs = fore[:, :-1, :, None] * move * (local * back)[:, 1:, None, :]
    pairs = pairs / pairs.sum((2, 3), keepdims=True) * real[:, 1:, None, None]
    return marginal, pairs.sum((0, 1))


def fit(samples: list[tuple[int, np.ndarray]], steps: int = 300, decay: float = 1e-4) -> LineModel:
    """Fits the field to documents (label, base features); a document's label is the label of its lines.

    Gradient ascent (Adam) on the conditional likelihood. Without documents of both labels all weights stay zero.
    """
    cuts = np.zeros((BASE, _BINS), np.float32)
    model = LineModel(cuts, np.zeros(LineModel.width()), np.zeros((2, 2)))
    if len({label for label, _ in samples}) < 2:
        return model
    everything = np.vstack([x for _, x in samples])
    model.cuts = np.quantile(everything, np.linspace(0, 1, _BINS + 2)[1:-1], axis=0).T.astype(np.float32)
    samples = sorted(samples, key=lambda x: len(x[1]))
    batches = []
    for at in range(0, len(samples), 200):
        group = samples[at : at + 200]
        rows = [model.expand(x) for _, x in group]
        lengths = np.array([len(x) for x in rows])
        real = np.arange(lengths.max()) < lengths[:, None]
        labels = np.array([y for y, _ in group], float)
        batches.append((np.vstack(rows), real, labels))
    lines = sum(len(x[0]) for x in batches)
    theta = np.zeros(model.width() + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        grad = -decay * theta
        for rows, real, labels in batches:
            score = np.zeros(real.shape)
            score[real] = np.clip(rows @ theta[:-4], -30, 30)
            marginal, pairs = _expected(score, real, theta[-4:].reshape(2, 2))
            wanted = np.repeat(labels, real.sum(1))
            seen = np.zeros((2, 2))
            follow = real[:, 1:].sum(1)
            seen[1, 1], seen[0, 0] = (follow * labels).sum(), (follow * (1 - labels)).sum()
            grad[:-4] += (wanted - marginal[real]) @ rows / lines
            grad[-4:] += (seen - pairs).ravel() / lines
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        theta = theta + 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    model.weights, model.steps = theta[:-4], theta[-4:].reshape(2, 2)
    return model


def spread_runs(lines: np.ndarray, most: int, run: int = 50) -> list[np.ndarray]:
    """All lines as one run, or, when there are more than ``most``, runs from its start to its end with as many lines in all."""
    if len(lines) <= most:
        return [lines]
    run = min(run, most)
    starts = np.linspace(0, len(lines) - run, max(1, most // run)).astype(int)
    return [lines[x : x + run] for x in starts]


def train(docs: DataFrame, labels: DataFrame, most_documents: int = 4000, most_lines: int = 1000) -> LineModel:
    """Learns from at most ``most_documents`` labelled documents that are not held out, taken by a hash of their id.

    Both bounds hold for learning alone; of a longer document, runs of lines spread evenly over it teach, ``most_lines`` in all.
    """
    ship(docs.sparkSession)
    known = (
        labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)")
        .filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
        .select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_label"))
        .dropDuplicates(["_id"])
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(most_documents)
    )
    # the sample has at most most_documents rows of two numbers
    plain = docs.select(F.col("doc_id").cast("long").alias("_id"), whole_text().alias("text"))
    picked = plain.join(F.broadcast(known), "_id").select("_label", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, group in texts(batches):
            taught = [(label, run) for label, x in zip(ids, group) for run in spread_runs(line_features(x)[0], most_lines)]
            labels, runs = zip(*((label, run.tobytes()) for label, run in taught)) if taught else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(runs, pa.binary())], names=["label", "data"])

    rows = picked.mapInArrow(features, "label int, data binary").collect()
    rows = sorted((r.label, bytes(r.data)) for r in rows)
    return fit([(label, np.frombuffer(data, np.float32).reshape(-1, BASE)) for label, data in rows])


def score_documents(docs: DataFrame, model: LineModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, by its text alone.

    A null text counts as empty, an empty one as one empty line. A null doc_id is not held out. Repeated rows give repeated results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, group in texts(batches):
            scores = pa.array(map(model.score, group), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), scores], names=["doc_id", "score"])

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return map_texts(docs, run, "doc_id long, score double").select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, model: LineModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, with all their columns, in one pass without a shuffle."""
    ship(docs.sparkSession)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                scores = [model.score(text or "") for text in part.column(place).to_pylist()]
                yield part.filter(pa.array([x >= threshold for x in scores], pa.bool_()))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.schema)
