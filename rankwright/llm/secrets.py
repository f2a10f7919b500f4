"""Secrets in whole texts: fixed patterns, and random strings by a token-efficiency test.

A byte-pair vocabulary writes ordinary words with few tokens. A long string without spaces that
needs many tokens for its characters is not made of words; unless it is a digest of a known length
or an identifier (UUID, number), it is reported as ``random``. Strings that pass as a whole are
tested in their parts between ``- _ = + /`` too, so that words beside a random part don't hide it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwright.llm.words import buffers, slices

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "random")

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
_STRINGS = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_IDENTIFIER = re.compile(
    r"[0-9]+|[-_=+/]*|(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})"
    r"|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}",
    re.I | re.A,
)
_UUID = re.compile(r"(?<![0-9a-z])[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![0-9a-z])", re.I | re.A)
# digests as browsers and lock files write them, in base64
_NAMED_DIGEST = re.compile(
    r"(?<![A-Za-z0-9])sha(?:1-[A-Za-z0-9+/]{27}=|256-[A-Za-z0-9+/]{43}=|384-[A-Za-z0-9+/]{64}|512-[A-Za-z0-9+/]{86}==)(?![A-Za-z0-9+/=])"
)
_PART = re.compile(r"[A-Za-z0-9]+")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_DENSE = np.zeros(256, dtype=bool)
_DENSE[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
_SHORTEST = 20  # of the strings that access, hex and random are found in

#: How texts are cut before byte pairs are joined, as published for the vocabulary. Fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class SecretSpec:
    """``vocabulary`` is a tiktoken rank file that executors can open."""

    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern: str = PATTERN
    chars_per_token: float = 2.0  # at most, for a random string
    remembered: int = 200_000


class _Efficiency:
    """Characters per token of a string."""

    def __init__(self, spec: SecretSpec) -> None:
        import base64

        import tiktoken

        with open(spec.vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=spec.pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, float] = {}
        self.most = spec.remembered

    def __call__(self, value: str) -> float:
        if value not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[value] = len(value) / len(self.encoding.encode_ordinary(value))
        return self.known[value]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place in ``KINDS``, end) of the pattern matches."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(found)


def _outside(start: int, end: int, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What sorted ``spans`` leave of the range from ``start`` to ``end``."""
    for a, b in spans:
        if a < end and start < b:
            if start < a:
                yield start, a
            start = max(start, b)
    if start < end:
        yield start, end


def random_parts(value: str, efficiency, spec: SecretSpec) -> list[tuple[int, int]]:
    """(start, end) of the random stretches of a string.

    A part gains by its tokens and loses by its characters. A stretch begins with a part that gains,
    ends where its sum is highest, and is given up when it falls below zero. Numbers and digests
    count nothing, and the gaining parts must have ``_SHORTEST`` characters.
    """
    found = []
    for first, last in _outside(0, len(value), [m.span() for m in _UUID.finditer(value)]):
        parts = []
        for m in _PART.finditer(value, first, last):
            tokens = 0 if _IDENTIFIER.fullmatch(m[0]) else len(m[0]) / efficiency(m[0])
            parts.append((m.start(), m.end(), tokens and spec.chars_per_token * tokens - len(m[0]), tokens > 0))
        i = 0
        while i < len(parts):
            if parts[i][2] < 0 or not parts[i][3]:
                i += 1
                continue
            total, best, end, size, dense = 0.0, -1.0, i, 0, 0
            for j in range(i, len(parts)):
                a, b, gain, counts = parts[j]
                total += gain
                if total < 0:
                    break
                if counts and gain >= 0:
                    size += b - a
                    if total >= best:
                        best, end, dense = total, j, size
            if dense >= _SHORTEST:
                found.append((parts[i][0], parts[end][1]))
            i = end + 1
    return found


def random_spans(text: str, base: list[tuple[int, int, int]], efficiency, spec: SecretSpec) -> list[tuple[int, int, int]]:
    """Random strings, and random parts of strings, outside the base spans and named digests."""
    found = []
    taken = [(a, b) for a, _, b in base]
    if "sha" in text:
        taken = sorted(taken + [m.span() for m in _NAMED_DIGEST.finditer(text)])
    for m in _STRINGS.finditer(text):
        for start, end in _outside(m.start(), m.end(), taken):
            value = text[start:end].strip("=-_/+")
            if len(value) < _SHORTEST or _IDENTIFIER.fullmatch(value):
                continue
            if efficiency(value) <= spec.chars_per_token:
                found.append((start, 3, end))
            else:
                found += [(start + a, 3, start + b) for a, b in random_parts(text[start:end], efficiency, spec)]
    return found


def _flagged(column: pa.Array) -> np.ndarray:
    """Rows that may hold a secret: with a long dense string or one of the words of ``assign``."""
    data, offsets = buffers(column)
    flags = np.zeros(len(column) + 1, dtype=bool)
    dense = np.zeros(len(data) + 2, dtype=np.int8)
    dense[1:-1] = _DENSE[data]
    edges = np.diff(dense)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    # a run over a row's end is flagged in all its rows; the patterns decide
    hot = ends - starts >= _SHORTEST
    rows = np.searchsorted(offsets, starts[hot], side="right") - 1
    last = np.searchsorted(offsets, ends[hot] - 1, side="right") - 1
    for a, b in zip(rows, last):
        flags[a : b + 1] = True
    raw = _LOWER[data].tobytes()
    for word in _WORDS:
        at = raw.find(word)
        while at >= 0:
            flags[np.searchsorted(offsets, at, side="right") - 1] = True
            at = raw.find(word, at + len(word))
    return flags


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(spec: SecretSpec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        efficiency = _Efficiency(spec)
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for part in slices(batch, "text"):
                texts, flags = part.column("text"), _flagged(part.column("text"))
                counts: list[list[int]] = [[], [], [], []]
                digests, spans = [], []
                for i in range(part.num_rows):
                    if not flags[i]:
                        for c in counts:
                            c.append(0)
                        digests.append(nothing)
                        spans.append("")
                        continue
                    text = texts[i].as_py() or ""
                    base = base_spans(text)
                    every = sorted(base + random_spans(text, base, efficiency, spec))
                    for k, c in enumerate(counts):
                        c.append(sum(s[1] == k for s in every))
                    digests.append(hashlib.sha256(_join(base).encode()).hexdigest())
                    spans.append(_join(every))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests), pa.array(spans)],
                    ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
                )

    return run


def find_secrets(docs: DataFrame, spec: SecretSpec = SecretSpec()) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans`` for each row of ``docs``.

    Needs ``doc_id`` and ``text``; other columns are ignored. ``spans`` lists kind:start:end by
    start and then kind, in code points with the end excluded, of whole matches. ``base_sha256``
    is the digest of the list without the random strings. Null and empty texts have no spans, and
    the digest of nothing. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    return docs.mapInArrow(_scan(spec), schema)
