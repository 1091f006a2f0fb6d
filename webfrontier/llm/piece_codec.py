"""Exact merge-type encoding of a piece vocabulary by backtracking, and decoding.

A token sequence is what merging gives exactly when every two neighbours are: merging their joined text again gives
the same two. So a text is read from left to right by longest match; where a match and its left neighbour are not
compatible, the next shorter piece is tried, and where none is left, the position is marked as failed and the
neighbour is taken back. No position fails twice, so the work is linear in the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from webfrontier.llm.common import map_texts, texts

SPACE = "▁"
#: A worker forgets chunks and pairs when they take so many bytes, by estimate, and keeps no chunk of more letters than LONG, such
#: as texts without blanks are; ids do not depend on that.
KEPT_BYTES = 450_000_000
LONG = 64
#: Estimate of what an entry takes besides four bytes for each of its letters and eight for each id.
ENTRY_BYTES = 220
_CODECS: dict[str, Any] = {}


class PieceCodec:
    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)  # read for its pieces and scores only
        count = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(count)]
        pieces = [model.id_to_piece(i) for i in range(count)]
        self.byte_ids = {int(pieces[i][3:5], 16): i for i in range(count) if model.is_byte(i)}
        self.surface = [
            bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if special[i] else p.replace(SPACE, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.names = [str(i) for i in range(count)]
        self.ids = {p: i for i, p in enumerate(pieces) if not (special[i] or model.is_byte(i))}
        self.scores = {p: model.get_score(i) for p, i in self.ids.items()}
        self.touching = {pair for p in self.ids for pair in zip(p, p[1:])}
        self.whole = any(a != SPACE and b == SPACE for a, b in self.touching)  # then spaces are no borders
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) > 1 and self.merged(piece) == [piece]:  # others never come out of merging
                self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.shorter: dict[str, str] = {}
        self.forget()

    def forget(self) -> None:
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.held = 0

    def merged(self, text: str) -> list[str]:
        """Merging as it is defined, for short texts: the best-scored neighbours first, of equals the leftmost."""
        parts, none = list(text), float("-inf")
        score = self.scores.get
        scored = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while scored:
            best = max(scored)
            if best == none:
                break
            at = scored.index(best)
            parts[at] += parts.pop(at + 1)
            del scored[at]
            if at:  # only the neighbours of what was merged have other scores now
                scored[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(scored):
                scored[at] = score(parts[at] + parts[at + 1], none)
        return parts

    def compatible(self, left: str, right: str) -> bool:
        found = self.pairs.get((left, right))
        if found is None:
            if (left[-1], right[0]) in self.touching:
                found = self.merged(left + right) == [left, right]
            else:
                found = True
            self.pairs[left, right] = found
            self.held += ENTRY_BYTES
        return found

    def next_shorter(self, piece: str) -> str:
        """The longest piece that is a shorter prefix; a single letter stands for itself, without it ''."""
        found = self.shorter.get(piece)
        if found is None:
            found = piece[:-1]
            while len(found) > 1 and not self.automaton.exists(found):
                found = found[:-1]
            self.shorter[piece] = found
        return found

    def backtrack(self, text: str) -> list[str]:
        # matches come by their ends, so the last one of a start is its longest
        sizes = {last + 1 - size: size for last, size in self.automaton.iter(text)}
        failed = 0  # a bit for every position from which no valid rest was found
        found: list[str] = []
        at, piece = 0, text[: sizes.get(0, 1)]
        while True:
            if not piece:  # nothing fits here: give the neighbour back and try it shorter
                failed |= 1 << at
                piece = found.pop()
                at -= len(piece)
                piece = self.next_shorter(piece)
                continue
            end = at + len(piece)
            if failed >> end & 1 or (found and not self.compatible(found[-1], piece)):
                piece = self.next_shorter(piece)
                continue
            found.append(piece)
            if end == len(text):
                return found
            at, piece = end, text[end : end + sizes.get(end, 1)]

    def part(self, text: str) -> tuple[int, ...]:
        ids = self.parts.get(text)
        if ids is None:
            ids = tuple(
                chain.from_iterable(
                    (self.ids[p],) if p in self.ids else map(self.byte_ids.__getitem__, p.encode())
                    for p in self.backtrack(text)
                )
            )
            if len(text) <= LONG:
                self.parts[text] = ids
                self.held += ENTRY_BYTES + 4 * len(text) + 8 * len(ids)
        return ids

    def chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a chunk, cut where no piece has the two letters side by side."""
        touching = self.touching
        cuts = [i for i, pair in enumerate(zip(chunk, chunk[1:]), 1) if pair not in touching]
        ends = [*cuts, len(chunk)]
        return tuple(chain.from_iterable(self.part(chunk[a:b]) for a, b in zip([0, *cuts], ends)))

    def encode(self, text: str) -> list[int]:
        """Ids of a text: a space is put before it, and chunks begin at spaces. An empty text has none."""
        if not text:
            return []
        if self.held > KEPT_BYTES:
            self.forget()
        words = [text.replace(" ", SPACE)] if self.whole else text.replace(SPACE, " ").split(" ")
        if "" in words:  # several spaces in a row belong to one chunk
            words = _runs(words)
        kept = self.chunks
        try:
            return list(chain.from_iterable(map(kept.__getitem__, words)))
        except KeyError:
            long: dict[str, tuple[int, ...]] = {}
            for word in set(words).difference(kept):
                ids = self.chunk(SPACE + word)
                if len(word) > LONG:
                    long[word] = ids
                else:
                    kept[word] = ids
                    self.held += ENTRY_BYTES + 4 * len(word) + 8 * len(ids)
            found = (long[x] if x in long else kept[x] for x in words) if long else map(kept.__getitem__, words)
            return list(chain.from_iterable(found))

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces and bytes joined, without the space that encoding puts before the text."""
        data = b"".join(map(self.surface.__getitem__, ids))
        return data.removeprefix(b" ").decode(errors="replace")


def _runs(words: list[str]) -> list[str]:
    """Joins empty words, which stand between spaces, with the word behind them."""
    joined, spaces = [], ""
    for word in words[:-1]:
        if word:
            joined.append(spaces + word)
            spaces = ""
        else:
            spaces += SPACE
    return [*joined, spaces + words[-1]]


def piece_codec(path: str) -> PieceCodec:
    """The worker's codec for a vocabulary file."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode_pieces(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every row; a null text counts as empty and has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = piece_codec(path)
        for group, bodies in texts(batches):
            columns = [pa.array(group, pa.int64()), pa.array(map(codec.encode, bodies), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids"])

    return map_texts(docs, run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, encoded and decoded in one pass.

    A null or empty text has no tokens and the hashes of an empty string. Repeated rows give repeated results, a null doc_id stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = piece_codec(path)
        for group, bodies in texts(batches):
            rows = []
            for text in bodies:
                ids = codec.encode(text)
                spelled = ",".join(map(codec.names.__getitem__, ids)).encode()
                decoded = codec.decode(ids).encode()
                rows.append((len(ids), hashlib.sha256(spelled).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), *map(pa.array, zip(*rows))], names=names)

    return map_texts(docs, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
