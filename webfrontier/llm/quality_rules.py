"""Quality rules: word and line counts of a document, and compression bands."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from webfrontier.llm.common import map_texts, texts

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
WINDOW = 3
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, ratio double, least_chunk double, most_chunk double, kept boolean"
)


@dataclass(frozen=True)
class Bands:
    """Allowed compressed share of a text, by its length in bytes.

    ``whole`` has (from so many bytes, least, most): below the least a text repeats itself, above the most it is
    noise. The share falls with the length because a longer text has more to refer back to. ``chunk`` has the limits
    for the pieces of ``chunk_bytes`` from the start on and for the last ``chunk_bytes`` of the text, so that a repetitive or
    random stretch shows inside a sound document and at its end.
    Texts shorter than the first limit pass: a frame's overhead hides their content.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (128, 0.40, 1.00),
        (256, 0.36, 0.85),
        (512, 0.32, 0.78),
        (1024, 0.28, 0.72),
        (4096, 0.24, 0.68),
        (16384, 0.20, 0.66),
    )
    chunk_bytes: int = 1024
    chunk: tuple[float, float] = (0.25, 0.72)
    level: int = 3


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three that occur twice or more in the text, the first occurrence included."""
    grams = list(zip(words, words[1:], words[2:]))
    counts = Counter(grams)
    if len(counts) == len(grams):
        return 0
    total, covered = 0, 0  # covered: end of the last repeated window
    for at, gram in enumerate(grams):
        if counts[gram] > 1:
            total += at + WINDOW - max(at, covered)
            covered = at + WINDOW
    return total


def compression(data: bytes, compressor: zstandard.ZstdCompressor, bands: Bands) -> tuple[float, float, float]:
    """Compressed share of the whole text, and the least and most of its chunks (1 where the text is shorter than one)."""
    if not data:
        return 1.0, 1.0, 1.0
    size = bands.chunk_bytes
    starts = [*range(0, len(data) - size + 1, size)]
    if len(data) > size and len(data) % size:
        starts.append(len(data) - size)
    chunks = [len(compressor.compress(data[at : at + size])) / size for at in starts]
    return len(compressor.compress(data)) / len(data), min(chunks, default=1.0), max(chunks, default=1.0)


def in_bands(n_bytes: int, ratio: float, least: float, most: float, bands: Bands) -> bool:
    limits = [x for x in bands.whole if n_bytes >= x[0]]
    if not limits:
        return True
    whole = limits[-1][1] <= ratio <= limits[-1][2]
    return whole and (n_bytes < bands.chunk_bytes or (bands.chunk[0] <= least and most <= bands.chunk[1]))


def judge(text: str, compressor: zstandard.ZstdCompressor, bands: Bands) -> tuple:
    data = text.encode()
    words = data.split()  # bytes split at ASCII white space only
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    repeats = repeated_words(words)
    failed = len(words) < 50 or 100 * repeats > 50 * len(words)
    ratio, least, most = compression(data, compressor, bands)
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeats,
        failed,
        ratio,
        least,
        most,
        not failed and in_bands(len(data), ratio, least, most, bands),
    )


def quality_rules(docs: DataFrame, bands: Bands | None = None) -> DataFrame:
    """One row per row of ``docs``, by SCHEMA. A null text counts as empty and fails (it has no words).

    Rows are judged one by one: a repeated row gives a repeated result, and a null doc_id stays null."""
    limits = bands or Bands()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=limits.level)
        for ids, group in texts(batches):
            columns = zip(*(judge(x, compressor, limits) for x in group))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, columns)], names=NAMES)

    return map_texts(docs, run, SCHEMA)


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
