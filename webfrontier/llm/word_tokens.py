"""Token ids of a word-level byte-pair vocabulary, computed once per distinct word of a task.

The vocabulary drops white space and never merges across it, so the ids of a text are those of its
blank-separated chunks one after another. A Python worker keeps the ids of chunks it has met.
"""

from __future__ import annotations

import re
import struct
from typing import Any

import numpy as np

#: A worker forgets its chunks and marks when they take so many bytes, by estimate, and keeps none of more letters than
#: LONG, such as texts without blanks are; ids do not depend on that.
KEPT_BYTES = 300_000_000
LONG = 64
#: Estimate of what an entry takes besides its ids and four bytes for each of its letters.
ENTRY_BYTES = 180
#: Chunks of letters that normalisation only lower-cases, with punctuation behind: their letters and their
#: punctuation are separate words of the vocabulary. Everything else goes through the library as it is.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!#$%&()*+,./:;=?@^_|-]*)")
#: str.split() also splits at these, which the vocabulary does not take for white space.
_CONTROLS = re.compile("[\x1c-\x1f]")
_ODD = re.compile("[ \t\n\v\f\r]+")
_ENCODERS: dict[str, Any] = {}


def byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write the bytes: printable Latin-1 stays, the rest follows from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in set(kept)]
    return {**{x: chr(x) for x in kept}, **{x: chr(256 + at) for at, x in enumerate(rest)}}


class _Chunks(dict):
    """Ids of the chunks met; one that is looked up for the first time is encoded, and kept if it is not long.

    The letters of a plain chunk are a chunk themselves, so each word is kept once, whatever marks stand behind it.
    """

    def __init__(self, encoder: ChunkEncoder) -> None:
        self.encoder = encoder
        self.bytes = 0

    def __missing__(self, chunk: str) -> bytes:
        if plain := _PLAIN.fullmatch(chunk):
            letters, marks = plain.groups()
            word = letters.lower()
            ids = self.encoder.spell(chunk) if word == chunk else self[word] + self.encoder.word(marks) if marks else self[word]
        else:
            ids = self.encoder.whole(chunk)
        if len(chunk) <= LONG:
            self[chunk] = ids
            self.bytes += ENTRY_BYTES + 4 * len(chunk) + len(ids)
        return ids


class ChunkEncoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.packed = [_pack([x]) for x in range(self.tokenizer.get_vocab_size())]
        self.words: dict[str, bytes] = {}
        self.chunks = _Chunks(self)
        self.word_bytes = 0

    @property
    def chunk_bytes(self) -> int:
        return self.chunks.bytes

    def spell(self, word: str) -> bytes:
        # printable ASCII is spelled as it is, and letters and marks have no other
        spelled = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        return b"".join([self.packed[x.id] for x in self.model.tokenize(spelled)])

    def word(self, marks: str) -> bytes:
        ids = self.words.get(marks)
        if ids is None:
            ids = self.spell(marks)
            if len(marks) <= LONG:
                self.words[marks] = ids
                self.word_bytes += ENTRY_BYTES + 4 * len(marks) + len(ids)
        return ids

    def whole(self, chunk: str) -> bytes:
        return _pack(self.tokenizer.encode(chunk, add_special_tokens=False).ids)

    def ids(self, text: str) -> np.ndarray:
        """All ids of a text as uint32."""
        chunks = _ODD.split(text) if _CONTROLS.search(text) else text.split()
        if self.chunks.bytes + self.word_bytes > KEPT_BYTES:
            self.chunks.clear()
            self.words.clear()
            self.chunks.bytes = self.word_bytes = 0
        data = b"".join(map(self.chunks.__getitem__, chunks))
        return np.frombuffer(data, np.uint32)


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"={len(ids)}I", *ids)


def chunk_encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
