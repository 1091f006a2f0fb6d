"""Phrase collocations: counts of all phrases from the counts of the longest windows alone.

Every word begins one window: itself and the words behind it in its piece, as the columns w1 to w4, padded with empty
words. Only these windows are counted. Spark's ROLLUP sums them over w4, then w3, then w2, and so gives the count
of every shorter phrase, since an occurrence of a phrase is a window that begins with it.

Most windows of four words are unlike all others. So that they needn't travel, a first pass counts phrases by their hash in
2^34 slots, and a window ends before the word with which its phrase falls into a slot of less than ``min_count``. No phrase that is
frequent enough is cut by it, and neither are its parts, so the counts that are used are exact. Only slots in use are kept and
travel, some two bytes for each, and the full ones come back as a table with bits in proportion to their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webfrontier.llm.common import settled, ship, whole_text

MOST_WORDS, MIN_COUNT, TOP = 4, 30, 2000
#: A candidate is dropped when a longer one around it has this share of its occurrences, in hundredths.
ABSORBED = 80
SCORE_SCALE = 2_000_000
#: Slots of the first pass, and blocks they travel in, as powers of two. A slot's place in its block and its count fill 32 bits.
SLOT_BITS, BLOCK_BITS = 34, 10
_PLACE_BITS = SLOT_BITS - BLOCK_BITS
#: A table of full slots has so many bits at least and at most, as powers of two, and in between 64 or more for each full slot.
LEAST_BITS, FULL_BITS, ROOM = 20, 29, 64
#: A task sends its slots on beyond so many.
MOST_SLOTS = 1 << 24
_PLANES = ["low", "middle", "high", "counts"]
#: Text is looked at in stretches of so many bytes (a longer text is one stretch), a task's word list is begun anew beyond so many words.
STRETCH, MOST_KNOWN = 4_000_000, 400_000
#: Bytes that end a piece become this one, which no UTF-8 text has; A to Z become a to z, and a tab a blank.
_END = 0xFF
_FROM = b".,;:!?\n\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TO = bytes([_END] * 10) + b" abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes.maketrans(_FROM, _TO)
WORDS = ["w1", "w2", "w3", "w4"]
_SALTS = 64


class Words(dict):
    """Numbers of the words of a task, in the order in which they come; number 0 is the end of a piece."""

    def __init__(self):
        super().__init__({bytes([_END]): 0})
        self.hashes = np.zeros(1024, dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        if number >= len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros(len(self.hashes), dtype=np.uint64)])
        self.hashes[number] = xxhash.xxh3_64_intdigest(word)
        return number

    def read(self, texts: list[bytes]) -> np.ndarray:
        """Numbers of the words of the texts, with a 0 behind each piece and four at the end."""
        end = bytes([_END])
        tokens = end.join(texts).translate(_FOLD).replace(end, b" " + end + b" ").split()
        numbers = np.zeros(len(tokens) + MOST_WORDS, dtype=np.int64)
        numbers[: len(tokens)] = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        return numbers


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, in stretches."""
    kept: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            kept.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text)
            if sizes[lang] > STRETCH:
                yield lang, kept.pop(lang)
                sizes[lang] = 0
    yield from kept.items()


def _slots(words: Words, lang: str, numbers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For phrases of two, three and four words: whether one begins at each word, and its slot."""
    last = len(numbers) - MOST_WORDS
    hashes = words.hashes[numbers]
    phrase = hashes[:last] ^ np.uint64(xxhash.xxh3_64_intdigest(lang))
    whole = numbers[:last] > 0
    for behind in range(1, MOST_WORDS):
        phrase = (phrase * np.uint64(0x9E3779B97F4A7C15)) ^ (phrase >> np.uint64(31))
        phrase = (phrase + hashes[behind : last + behind]) * np.uint64(0xD6E8FEB86659FD93)
        whole = whole & (numbers[behind : last + behind] > 0)
        yield whole, phrase >> np.uint64(64 - SLOT_BITS)


def _added(parts: list[np.ndarray]) -> np.ndarray:
    """Slots with their counts in the lowest byte, in order and each slot once. Counts above 255 are not told apart."""
    every = np.sort(np.concatenate(parts))
    slots = every >> 8
    new = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]][: len(slots)])
    n = np.add.reduceat(every & 255, new) if len(new) else every
    return (slots[new] << 8) | np.minimum(n, 255).astype(every.dtype)


def _packed_blocks(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The slots of sorted parts: distances within a block and counts, each byte of them apart, as most bytes but the lowest are alike."""
    pack = zstandard.ZstdCompressor(level=1)
    for at in range(0, 1 << BLOCK_BITS, 64):
        ends = np.arange(at, at + 65, dtype=np.uint64) << np.uint64(32)
        every = _added([part[slice(*np.searchsorted(part, ends[[0, -1]]))] for part in parts])
        rows = []
        for n, (start, stop) in enumerate(pairwise(np.searchsorted(every, ends)), at):
            if start < stop:
                block = every[start:stop].astype(np.uint32)
                distances = np.diff(block >> 8, prepend=np.uint32(0))
                planes = ((distances << 8) | (block & 255)).astype("<u4").view(np.uint8).reshape(-1, 4).T
                rows.append((n, *(pack.compress(planes[x].tobytes()) for x in (1, 2, 3, 0))))
        if rows:
            block, *planes = zip(*rows)
            columns = [pa.array(block, pa.int32()), *[pa.array(x, pa.binary()) for x in planes]]
            yield pa.RecordBatch.from_arrays(columns, ["block", *_PLANES])


def _unpacked(planes: tuple[bytes, ...], unpack: zstandard.ZstdDecompressor) -> np.ndarray:
    low, middle, high, counts = (np.frombuffer(unpack.decompress(x), dtype=np.uint8) for x in planes)
    distances = np.stack([low, middle, high, np.zeros_like(low)], axis=1).view("<u4")[:, 0]
    return (np.cumsum(distances, dtype=np.uint32) << 8) | counts


def _count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, words = [], Words()
    for lang, texts in _stretches(batches):
        if len(words) > MOST_KNOWN:
            words = Words()
        numbers = words.read(texts)
        parts.append(_added([(slots[whole] << np.uint64(8)) | np.uint64(1) for whole, slots in _slots(words, lang, numbers)]))
        if sum(map(len, parts)) > MOST_SLOTS:
            yield from _packed_blocks(parts)
            parts = []
    if parts:
        yield from _packed_blocks(parts)


def _full_slots(min_count: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of a partition in their order, each added up as its rows come; then a bit per part of a block with a full slot."""
        unpack = zstandard.ZstdDecompressor()
        rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
        for block, group in groupby(rows, key=itemgetter(0)):
            parts, size = [], 0
            for _, *planes in group:
                parts.append(_unpacked(planes, unpack))
                size += len(parts[-1])
                if size > MOST_SLOTS:
                    parts, size = [_added(parts)], 0
            total = _added(parts)
            # Numbers above min_count are not told apart, so a byte is enough.
            places = total[(total & 255) >= min(min_count, 255)] >> 8
            if len(places):
                there = np.zeros(1 << (FULL_BITS - BLOCK_BITS), dtype=bool)
                there[places >> (SLOT_BITS - FULL_BITS)] = True
                bits = zstandard.compress(np.packbits(there).tobytes(), 1)
                columns = [pa.array([block], pa.int32()), pa.array([np.count_nonzero(there)], pa.int64()), pa.array([bits], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "n", "bits"])

    return sums


def _table(blocks: dict[int, bytes], n: int) -> np.ndarray:
    """Bits of all blocks, n of them set, in a table that has room for them: of neighbours that share a bit one is enough."""
    size = min(FULL_BITS, max(LEAST_BITS, (ROOM * n).bit_length()))
    table = np.zeros((1 << BLOCK_BITS, 1 << (size - BLOCK_BITS - 3)), dtype=np.uint8)
    for block, bits in blocks.items():
        there = np.zeros(1 << (size - BLOCK_BITS), dtype=bool)
        there[np.flatnonzero(np.unpackbits(np.frombuffer(zstandard.decompress(bits), dtype=np.uint8))) >> (FULL_BITS - size)] = True
        table[block] = np.packbits(there)
    return table.reshape(-1)


def _windows(full):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, words, alone = full.value, Words(), {}
        finer = np.uint64(SLOT_BITS + 1 - (8 * len(bits)).bit_length())

        def texts_of(names: pa.Array, numbers: np.ndarray) -> pa.Array:
            return names.take(pa.array(numbers, pa.int64()))

        def singles(names: pa.Array) -> Iterator[pa.RecordBatch]:
            for lang, n in alone.items():
                there = np.flatnonzero(n)
                there = there[there > 0]
                none = pa.array([""] * len(there), pa.string())
                columns = [pa.array([lang] * len(there), pa.string()), texts_of(names, there), none, none, none, pa.array(n[there], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", *WORDS, "n"])

        def names_of() -> pa.Array:
            return pa.array([b"", *list(words)[1:]], pa.binary()).cast(pa.string())

        for lang, texts in _stretches(batches):
            if len(words) > MOST_KNOWN:
                yield from singles(names_of())
                words, alone = Words(), {}
            numbers = words.read(texts)
            last = len(numbers) - MOST_WORDS
            longer, window = np.ones(last, dtype=bool), [numbers[:last]]
            for behind, (whole, slots) in enumerate(_slots(words, lang, numbers), 1):
                longer = longer & whole
                at = np.flatnonzero(longer)
                slot = slots[at] >> finer
                longer[at] = (bits[slot >> np.uint64(3)] >> (7 - (slot & np.uint64(7))).astype(np.uint8)) & 1
                window.append(np.where(longer, numbers[behind : last + behind], 0))
            several = window[1] > 0
            n = np.bincount(window[0][~several], minlength=len(words))
            n[: len(alone.get(lang, ()))] += alone.get(lang, np.zeros(0, dtype=np.int64))
            alone[lang] = n
            keys = np.stack([(window[0][several] << 32) | window[1][several], (window[2][several] << 32) | window[3][several]])
            if keys.shape[1]:
                keys = keys[:, np.lexsort(keys)]
                new = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
                n = np.diff(np.r_[new, keys.shape[1]])
                keys, names = keys[:, new], names_of()
                for at in range(0, len(n), 50_000):
                    part = keys[:, at : at + 50_000]
                    numbers = [part[0] >> 32, part[0] & 0xFFFFFFFF, part[1] >> 32, part[1] & 0xFFFFFFFF]
                    columns = [pa.array([lang] * part.shape[1], pa.string()), *[texts_of(names, x) for x in numbers], pa.array(n[at : at + 50_000], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", *WORDS, "n"])
        yield from singles(names_of())

    return count


def window_counts(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``(lang, w1, w2, w3, w4, n)``: the longest windows and how often they are there; a null lang is ``und``."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), whole_text().cast("binary").alias("text"))
    slots = rows.mapInArrow(_count_slots, "block int, " + ", ".join(f"{x} binary" for x in _PLANES)).repartition("block").sortWithinPartitions("block")
    blocks, n = {}, 0
    table = settled(slots.mapInArrow(_full_slots(min_count), "block int, n long, bits binary"), "full-slots")
    # At most a bit for 32 slots comes to the driver: 64 MB, whatever the input, and packed.
    for row in table.toLocalIterator():
        blocks[row["block"]] = bytes(row["bits"])
        n += row["n"]
    full = spark.sparkContext.broadcast(_table(blocks, n))
    windows = rows.mapInArrow(_windows(full), "lang string, w1 string, w2 string, w3 string, w4 string, n long")
    return windows.groupBy("lang", *WORDS).agg(F.sum("n").alias("n"))


def phrase_counts(windows: DataFrame) -> DataFrame:
    """``(lang, k, phrase, f)`` from the counts of the longest windows; k is the number of words, and the row with k 0 has the
    number of all words."""
    summed = windows.rollup("lang", *WORDS).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    ends = [(0b01111, 0), (0b00111, 1), (0b00011, 2), (0b00001, 3), (0b00000, 4)]
    words = F.array(*WORDS)
    k = F.coalesce(*[F.when(F.col("level") == bits, F.lit(n)) for bits, n in ends])
    summed = summed.select("lang", k.alias("k"), words.alias("words"), "f").where("k IS NOT NULL")
    summed = summed.where((F.col("k") == 0) | (F.get("words", F.col("k") - 1) != ""))
    return summed.select("lang", "k", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("phrase"), "f")


def _joined(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(counts: DataFrame) -> DataFrame:
    """``(lang, phrase, words, a, l, r, score)`` of phrases of two words and more by their lowest-scoring cut."""
    phrases = counts.where("k >= 2").select("lang", "phrase", F.split("phrase", " ").alias("words"), F.col("f").alias("a"))
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": _joined(F.col("words"), 1, F.col("k")), "rest": _joined(F.col("words"), F.col("k") + 1, F.size("words"))})
    known = counts.where("k >= 1")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr(f"CAST({SCORE_SCALE} AS DECIMAL(38, 0)) * a div (CAST(l AS DECIMAL(38, 0)) + r)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    best = cuts.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.first("a").alias("a"), lowest.alias("cut"))
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of two to four words of every language.

    Texts are split into pieces at ``.,;:!?`` and line ends, and these at blanks and tabs; A to Z count as a to z. ``a`` counts all
    occurrences of a phrase, overlapping ones too; phrases with less than ``min_count`` are no candidates. Of all cuts in two parts
    with the counts l and r, the one with the lowest floor(2000000 a / (l + r)) counts, of equal ones the shortest first part.
    A candidate inside a longer one that has at least 80 % of its occurrences is dropped. Order: score and a, falling, then phrase.

    A null text has no words, a null lang is ``und``, repeated rows count as often as they are there. Texts of any length are
    read whole; a language with less than ``top`` phrases gives what it has, one without any gives no row.
    """
    counts = phrase_counts(window_counts(docs, min_count))
    counts = settled(counts.where((F.col("k") == 0) | (F.col("f") >= min_count)), "phrase-counts")
    candidates = scored(counts)
    parts = counts.where("k >= 3").select("lang", F.split("phrase", " ").alias("words"), "f")
    places = F.sequence(F.lit(1), F.size("words") - F.col("k") + 1)
    parts = parts.select("*", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("k")).select("*", F.explode(places).alias("at"))
    inside = parts.groupBy("lang", _joined(F.col("words"), F.col("at"), F.col("k")).alias("phrase")).agg(F.max("f").alias("longer"))
    kept = candidates.join(inside, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(38,0)") < ABSORBED * F.col("a").cast("decimal(38,0)"))
    )
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # A language may have most phrases: each of its shares keeps its first ones before they meet.
    share = F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))
    kept = kept.withColumn("share", share)
    kept = kept.withColumn("place", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("place") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    sizes = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    return kept.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents),
    lists AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS words FROM pieces),
    sizes AS (SELECT lang, sum(len(words))::BIGINT AS n FROM lists GROUP BY lang),
    found AS (
        SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: words[i : i + k - 1])) AS words
        FROM lists, range(1, 5) AS lengths(k)),
    counts AS (SELECT lang, k, words, count(*) AS f FROM found GROUP BY ALL HAVING count(*) >= 30),
    cuts AS (
        SELECT c.lang, c.words, c.f AS a, cut, l.f AS l, r.f AS r, ((2000000::HUGEINT * c.f) // (l.f + r.f))::BIGINT AS score
        FROM (SELECT *, unnest(range(1, k)) AS cut FROM counts WHERE k >= 2) c
        JOIN counts l ON l.lang = c.lang AND l.words = c.words[1 : cut]
        JOIN counts r ON r.lang = c.lang AND r.words = c.words[cut + 1 :]),
    best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) = 1),
    parts AS (
        SELECT lang, f, words, k, unnest(range(2, k)) AS size FROM counts WHERE k >= 3),
    inside AS (
        SELECT lang, words, max(f) AS longer
        FROM (SELECT lang, f, unnest(list_transform(range(1, k - size + 2), lambda i: words[i : i + size - 1])) AS words FROM parts)
        GROUP BY lang, words),
    ranked AS (
        SELECT b.lang, array_to_string(b.words, ' ') AS phrase, a, l, r, score FROM best b
        LEFT JOIN inside i ON i.lang = b.lang AND i.words = b.words WHERE longer IS NULL OR 100 * longer < 80 * a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM ranked JOIN sizes USING (lang)
    QUALIFY rank <= 2000
"""
