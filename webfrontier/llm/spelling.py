"""Spelling variants: words one edit apart, found in a trie over counts of letter groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webfrontier.llm.common import ship, whole_text, written
from webfrontier.session import cut_and_count

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = r"A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: One run in so many of a document's distinct runs loses a letter.
SPOILED = 31
#: Levels of the trie: letters are dealt to so many groups.
GROUPS = 16
#: The first levels are the key that Spark deals words by, and more of them while a key has more than MOST words. What is
#: still larger on the last level is split into shares, and questions go to all shares of a key.
FIRST_LEVELS, MOST = 4, 20_000
#: A share holds at most MOST words of so many letters, or fewer longer ones.
USUAL_LENGTH = 16
#: So many letters of questions are looked up together, and so many pairs of a question and a word verified at once.
ASKED_LETTERS, PAIRS = 131_072, 400_000


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)`` of the words of all whole texts, with a letter taken out of some runs by the rule of the operator."""
    runs = F.regexp_extract_all(whole_text(), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    rows = rows.select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    rows = rows.select("run", hashed.alias("h"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    spoiled = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % SPOILED == 0, spoiled).otherwise(F.col("run")).alias("word")
    counted = rows.select(word).where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_count)


def letter_groups(words: DataFrame) -> list[str]:
    """The letters of the words dealt to GROUPS groups of about equal use: the most frequent first, each to the lightest group.

    There are at most as many letters as the pattern of a word allows, so this is a small table.
    """
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''")
    use = letters.groupBy("letter").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "letter").collect()
    groups, load = [""] * GROUPS, [0] * GROUPS
    for letter, n in use:
        lightest = load.index(min(load))
        groups[lightest] += letter
        load[lightest] += n
    return groups


def counts_of(word: Column, groups: list[str]) -> Column:
    """Length and the counts of the letter groups: the path of a word in the trie."""
    counts = [F.length(word) - F.length(F.translate(word, group, "")) if group else F.lit(0) for group in groups]
    return F.array(F.length(word), *counts)


def _key(counts: Column, levels: int) -> Column:
    return F.array_join(F.slice(counts, 1, levels + 1).cast("array<string>"), ",")


def key_levels(words: DataFrame, first: int = FIRST_LEVELS, most: int = MOST) -> int:
    """The fewest levels, from ``first`` on, with which no key has more than ``most`` words, or all levels."""
    for levels in range(first, GROUPS):
        sizes = words.groupBy(_key(F.col("counts"), levels).alias("key")).count()
        if (sizes.agg(F.max("count")).first()[0] or 0) <= most:
            return levels
    return GROUPS


def questions(words: DataFrame, levels: int) -> DataFrame:
    """``(key, word, spent)``: a word asks at each key that its budget of one surplus and one deficit leads to.

    Each pair is asked for once: by the shorter word, whose partner has one letter more and so a surplus only, and of
    equal lengths by the word whose partner has the surplus in an earlier group than the deficit. ``spent`` is 0
    while nothing is spent, 1 after the surplus and 2 after both. The first number of a path is the length.
    """
    counts = F.col("counts")
    places = F.sequence(F.lit(1), F.lit(levels)) if levels else F.array().cast("array<int>")
    head = F.slice(counts, 1, levels + 1)

    def changed(steps: dict) -> Column:
        def moved(count: Column, at: Column) -> Column:
            for place, by in steps:
                count = count + F.when(at == place, F.lit(by)).otherwise(F.lit(0))
            return count

        return F.transform(head, moved)

    def entry(path: Column, longer: int, spent: int) -> Column:
        key = F.array_join(path.cast("array<string>"), ",")
        return F.struct(key.alias("key"), F.lit(longer).alias("longer"), F.lit(spent).alias("spent"))

    zero = F.lit(0)
    found = F.concat(
        F.array(entry(changed([]), 0, 0), entry(changed([(zero, 1)]), 1, 0)),
        F.transform(places, lambda i: entry(changed([(zero, 1), (i, 1)]), 1, 1)),
        F.transform(places, lambda i: entry(changed([(i, 1)]), 0, 1)),
        F.flatten(
            F.transform(
                places,
                lambda i: F.transform(
                    F.filter(places, lambda j: (j > i) & (F.get(counts, j) > 0)),
                    lambda j: entry(changed([(i, 1), (j, -1)]), 0, 2),
                ),
            )
        ),
    )
    return words.select("word", F.explode(found).alias("q")).select("q.key", "word", "q.longer", "q.spent")


def codes_of(words: list[str], width: int) -> np.ndarray:
    """Code points of the words, one row each, filled up with zeros."""
    return np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)


class Trie:
    """The words of one key by their remaining counts; a node's children are found by its number and a count."""

    def __init__(self, words: list[str], groups: list[str], levels: int):
        self.table = np.full(256, 0, dtype=np.int64)
        for number, group in enumerate(groups):
            for letter in group:
                self.table[ord(letter)] = number
        self.levels = levels
        self.width = max(map(len, words))
        codes = codes_of(words, self.width)
        counts = self.counts(codes)[:, levels:]
        self.base = int(counts.max(initial=0)) + 3
        order = np.lexsort(counts.T[::-1]) if counts.shape[1] else np.arange(len(words))
        self.words, self.codes, counts = [words[i] for i in order], codes[order], counts[order]
        node = np.zeros(len(words), dtype=np.int64)
        self.edges = []
        for level in range(counts.shape[1]):
            edges, node = np.unique(node * self.base + counts[:, level] + 1, return_inverse=True)
            self.edges.append(edges)
        # Words lie by their paths, so a leaf is a stretch of them.
        self.first = np.searchsorted(node, np.arange(int(node[-1]) + 2))

    def counts(self, codes: np.ndarray) -> np.ndarray:
        group = self.table[np.minimum(codes, 255)]
        found = np.zeros((len(codes), GROUPS), dtype=np.int64)
        for at in range(codes.shape[1]):
            there = np.flatnonzero(codes[:, at])
            found[there, group[there, at]] += 1
        return found

    def near(self, asked: list[str], longer: int, spent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (number of a question, number of a word) that are one edit apart. All questions have one length."""
        codes = codes_of(asked, self.width)
        counts = self.counts(codes)[:, self.levels :]
        who = np.arange(len(asked))
        node, used = np.zeros(len(asked), dtype=np.int64), np.full(len(asked), spent)
        for level, edges in enumerate(self.edges):
            # The search goes down all paths of these questions at once: as it is, with the surplus, with the deficit.
            count = counts[who, level]
            moves = [(np.arange(len(who)), 0, used)]
            free = np.flatnonzero(used == 0)
            moves.append((free, 1, np.ones(len(free), dtype=np.int64)))
            if not longer:
                half = np.flatnonzero(used == 1)
                moves.append((half, -1, np.full(len(half), 2)))
            wanted = np.concatenate([node[i] * self.base + np.minimum(count[i] + by, self.base - 2) + 1 for i, by, _ in moves])
            beyond = np.concatenate([count[i] + by > self.base - 3 for i, by, _ in moves])
            at = np.minimum(np.searchsorted(edges, wanted), len(edges) - 1)
            there = np.flatnonzero((edges[at] == wanted) & ~beyond)
            who = np.concatenate([who[i] for i, _, _ in moves])[there]
            used = np.concatenate([u for _, _, u in moves])[there]
            node = at[there]
        done = used != 1 if not longer else used == 1
        who, node, used = who[done], node[done], used[done]
        sizes = self.first[node + 1] - self.first[node]
        found = []
        for part in _slices(sizes, PAIRS):
            n = sizes[part]
            a = np.repeat(who[part], n)
            b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[node[part]], n)
            same = np.repeat(used[part] == 0, n) if not longer else np.zeros(len(a), dtype=bool)
            good = self.one_edit(codes, a, b, len(asked[0]), longer)
            # Words with equal counts meet twice; the smaller one keeps the pair.
            for k in np.flatnonzero(good & same):
                good[k] = asked[a[k]] < self.words[b[k]]
            found.append((a[good], b[good]))
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def one_edit(self, codes: np.ndarray, a: np.ndarray, b: np.ndarray, length: int, longer: int) -> np.ndarray:
        """Whether the words differ by exactly one replaced letter, or by one that the second word has more."""
        if not longer:
            different = np.zeros(len(a), dtype=np.int16)
            for at in range(length):
                different += codes[a, at] != self.codes[b, at]
            return different == 1
        head, tail = np.zeros(len(a), dtype=np.int32), np.zeros(len(a), dtype=np.int32)
        same, behind = np.ones(len(a), dtype=bool), np.ones(len(a), dtype=bool)
        for at in range(length):
            same &= codes[a, at] == self.codes[b, at]
            head += same
            back = length - 1 - at
            behind &= codes[a, back] == self.codes[b, back + 1]
            tail += behind
        return head + tail >= length


def _slices(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Stretches whose sizes sum up to about ``most``."""
    if not len(sizes):
        return
    block = (np.cumsum(sizes) - 1) // most
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    for start, end in zip(starts, [*starts[1:], len(sizes)]):
        yield slice(start, end)


def _answers(groups: list[str], levels: int):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by place, the stored words of a place (kind 0) before the questions (kind 1), these by length and budget."""
        place, stored, trie, asked, state = None, [], None, [], None

        def ask() -> Iterator[pa.RecordBatch]:
            nonlocal trie
            if asked and stored:
                trie = trie or Trie(stored, groups, levels)
                a, b = trie.near(asked, *state)
                if len(a):
                    yield pa.RecordBatch.from_pydict({"a": [asked[i] for i in a], "b": [trie.words[i] for i in b]})
            asked.clear()

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in range(batch.num_columns)]
            for key, share, kind, word, longer, spent in zip(*columns):
                if (key, share) != place:
                    yield from ask()
                    place, stored, trie = (key, share), [], None
                if not kind:
                    stored.append(word)
                elif stored:
                    now = (longer, spent)
                    if asked and (now != state or len(word) != len(asked[0]) or len(asked) * len(word) >= ASKED_LETTERS):
                        yield from ask()
                    state = now
                    asked.append(word)
        yield from ask()

    return answer


def near_pairs(words: DataFrame, first_levels: int = FIRST_LEVELS, most: int = MOST) -> DataFrame:
    """``(a, b)``, each unordered pair of words that differ by exactly one inserted, deleted or replaced letter once."""
    groups = letter_groups(words)
    words = words.select("word", counts_of(F.col("word"), groups).alias("counts"))
    levels = key_levels(words, first_levels, most)
    stored = words.select(_key(F.col("counts"), levels).alias("key"), "word")
    sizes = stored.groupBy("key").agg(F.ceil(F.sum(F.length("word")) / (most * USUAL_LENGTH)).cast("int").alias("shares"))
    asked = questions(words, levels).join(sizes, "key")
    asked = asked.select("key", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(1).alias("kind"), "word", "longer", "spent")
    share = F.pmod(F.xxhash64("word"), F.col("shares")).cast("int")
    zero = F.lit(0)
    stored = stored.join(sizes, "key").select("key", share.alias("share"), zero.alias("kind"), "word", zero.alias("longer"), zero.alias("spent"))
    ship(words.sparkSession)
    rows = stored.unionByName(asked).repartition("key", "share")
    rows = rows.sortWithinPartitions("key", "share", "kind", "longer", "spent", F.length("word"))
    return rows.mapInArrow(_answers(groups, levels), "a string, b string")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for ``(word, form)``: the end of the chain of forms. Each round doubles the steps, and as the counts
    of a chain grow tenfold with each step, a chain is short."""
    found, moved = forms.select("word", F.col("form").alias("root")), 1
    while moved:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = found.join(further, "root", "left")
        joined = joined.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        found, moved = cut_and_count(joined, F.col("moved"))
    return found.select("word", "root")


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO,
                      first_levels: int = FIRST_LEVELS, most: int = MOST) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``, one row per word of the corpus.

    Words are maximal runs of letters, of at least ``min_length`` letters and ``min_count`` occurrences, A to Z lower-cased. Two
    are near if one inserted, deleted or replaced letter makes one the other. The form of a word is its
    near word with the largest n (of equal ones the smaller text), if that is at least ``ratio`` times its own; the root is the last form of the
    chain, and the word itself without one.

    A null text has no words, a null doc_id counts as an empty text in the rule that spoils runs. Repeated rows are counted as often
    as they are there. Texts and words of any length are read whole. Other columns are not read.
    """
    words = written(word_counts(docs, min_length, min_count), "spelling-words")
    pairs = written(near_pairs(words, first_levels, most), "spelling-pairs")
    both = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))))
    both = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    is_form = -F.col("best.less") >= ratio * F.col("n")
    table = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"),
    )
    table = written(table, "spelling-forms")
    ends = roots(table.where("form IS NOT NULL"))
    return table.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
