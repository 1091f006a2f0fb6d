"""Secret scan: fixed patterns, and strings that surrounding code and identifiers do not help to compress."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webfrontier.llm.common import map_texts, ship, texts, whole_text

KINDS = ("assign", "access", "hex", "novel")
#: Fixed patterns of the base kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Words that make what stands near them sensitive.
SENSITIVE = (*ASSIGN_WORDS, "api-key", "auth", "bearer", "credential", "private_key", "access_key", "passphrase", "pwd")
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
#: What code around secrets looks like; candidates made of it are not new.
CODE = (
    "import os sys json config settings environment variable default value example placeholder changeme your_api_key_here "
    "password = os.environ['PASSWORD'] secret_key token = getenv(\"TOKEN\") def class return self. None True False null "
    "private static final String public const let var function api_key: ${API_KEY} <your-token> username localhost "
    "https://example.com/login?user= Authorization: Bearer client_id client_secret access_token refresh_token "
    "xxxxxxxxxxxxxxxx 0123456789abcdef ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0000000000000000 "
)
IDENTIFIERS = (
    "getUserName setPassword handleRequest database_connection max_retry_count request_timeout_seconds test_case "
    "create_session_token validate_password user_id account_number file_name error_message response_status index_name "
)
LEAST_LETTERS = 16
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_LETTERS, re.ASCII)


@dataclass(frozen=True)
class Novelty:
    """A candidate of 16 or more letters is reported when it begins at most ``reach`` code points behind a sensitive
    word, or ends at most as many in front of one, and adds at least ``least`` compressed bytes for each of its own
    to the text around it (``around`` code points on either side) in a frame primed with the dictionaries."""

    reach: int = 48
    around: int = 256
    least: float = 0.6
    level: int = 3


def _hex_spans(text: str, data: bytes) -> list[tuple[int, int]]:
    """Runs of 24 or more small hexadecimal digits, in code points."""
    breaks = np.flatnonzero(~_HEX[np.frombuffer(data, np.uint8)])
    edges = np.concatenate([[-1], breaks, [len(data)]])
    wide = np.flatnonzero(np.diff(edges) > 24)
    ascii_only = len(text) == len(data)
    spans = []
    for at in wide.tolist():
        first, end = int(edges[at]) + 1, int(edges[at + 1])
        start = first if ascii_only else len(data[:first].decode())
        spans.append((start, start + end - first))
    return spans


def _near(text: str, places: set[tuple[int, int]], reach: int) -> set[tuple[int, int]]:
    """Candidates whose start lies near behind, or whose end near in front of, one of the ``places`` of words.

    A candidate that a word lies in gives what stands behind the word, and what in front of it.
    """
    runs = [m.span() for m in _CANDIDATE.finditer(text)]
    starts, ends = [x[0] for x in runs], [x[1] for x in runs]
    found = set()
    for start, end in places:
        found.update(runs[bisect_left(starts, end) : bisect_right(starts, end + reach)])
        found.update(runs[bisect_left(ends, start - reach) : bisect_right(ends, start)])
        for a, b in runs[bisect_right(ends, start) : bisect_left(starts, end)]:
            found.update(x for x in ((a, start), (end, b)) if x[1] - x[0] >= LEAST_LETTERS)
    return found


class SecretScanner:
    def __init__(self, rule: Novelty) -> None:
        primed = zstandard.ZstdCompressionDict((CODE + IDENTIFIERS).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.rule = rule
        self.compressor = zstandard.ZstdCompressor(level=rule.level, dict_data=primed)

    def base(self, text: str, data: bytes, low: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the fixed patterns, leftmost and without overlap within a kind."""
        found = []
        if any(x in low for x in ASSIGN_WORDS):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
        return sorted(found + [(a, 2, b) for a, b in _hex_spans(text, data)])

    def novelty(self, text: str, start: int, end: int) -> float:
        """Compressed bytes that a candidate adds to the text around it, for each byte of its own."""
        before = text[max(0, start - self.rule.around) : start].encode()
        behind = text[end : end + self.rule.around].encode()
        own = text[start:end].encode()
        with_it = len(self.compressor.compress(before + own + behind))
        return (with_it - len(self.compressor.compress(before + behind))) / len(own)

    def novel(self, text: str, low: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Candidates near sensitive words that no fixed pattern touches and that do not compress."""
        if len(low) != len(text):  # a letter whose small form is longer: keep the places of the text
            low = "".join(c.lower() if c.isascii() else c for c in text)
        places = {m.span() for word in SENSITIVE if word in low for m in re.finditer(word, low)}
        found, done = [], 0
        for a, b in sorted(_near(text, places, self.rule.reach), key=lambda x: (x[0], -x[1])):
            fresh = a >= done and not any(s < b and a < e for s, _, e in taken)
            if fresh and self.novelty(text, a, b) >= self.rule.least:
                found.append((a, 3, b))
                done = b
        return found

    def scan(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans, and all spans, by start and kind."""
        low = text.lower()
        base = self.base(text, text.encode(), low)
        more = self.novel(text, low, base) if any(x in low for x in SENSITIVE) else []
        return base, sorted(base + more)


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_secrets(docs: DataFrame, rule: Novelty | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row; a null text counts as empty."""
    rule = rule or Novelty()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = SecretScanner(rule)
        for ids, group in texts(batches):
            rows = []
            for text in group:
                base, spans = scanner.scan(text)
                kinds = [x[1] for x in base]
                digest = hashlib.sha256(spelled(base).encode()).hexdigest()
                rows.append((*map(kinds.count, range(3)), digest, spelled(spans)))
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, zip(*rows))], names=names)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return map_texts(docs, run, schema)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """The text with every span, overlapping ones as one, replaced by a mark."""
    parts, at = [], 0
    for start, _, end in spans:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact_secrets(docs: DataFrame, rule: Novelty | None = None) -> DataFrame:
    """``docs`` with secrets replaced in ``text`` and ``n_chars`` counted anew; rows without secrets stay as they are."""
    ship(docs.sparkSession)
    rule = rule or Novelty()
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = SecretScanner(rule)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                clean = []
                for text in part.column(place).to_pylist():
                    spans = scanner.scan(text)[1] if text else []
                    clean.append(redact(text, spans) if spans else text)
                yield part.set_column(place, part.schema.field(place), pa.array(clean, part.schema.field(place).type))

    out = docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length(whole_text()).cast(kind)))
    return out
