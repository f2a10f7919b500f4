"""Words as byte ranges of one clean buffer: lower-cased, joined by single spaces.

A phrase is then a contiguous range of that buffer, whatever stood between its words in the text.
All of it works on Arrow buffers with numpy. Separators are ASCII, so no character is cut.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from rankwright.llm.words import buffers

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_set(*parts: int | range) -> np.ndarray:
    """A table of 256 flags, set for the given bytes."""
    flags = np.zeros(256, dtype=bool)
    for part in parts:
        flags[part if isinstance(part, int) else list(part)] = True
    return flags


#: Letters and digits after lower-casing, and all that is not ASCII.
ALNUM = byte_set(range(0x30, 0x3A), range(0x61, 0x7B), range(0x80, 0x100))


@dataclass
class Runs:
    """The words of a slice of texts: row ``i`` has the words ``first[i]:first[i + 1]``.

    Word ``j`` is ``data[starts[j]:ends[j]]``, and a space follows it. ``piece`` numbers the
    stretches of text without a break; two words belong together if theirs are equal.
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    piece: np.ndarray

    @property
    def count(self) -> int:
        return len(self.starts)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ranges one after the other, with ``gap`` spaces behind each, and where each begins."""
    sizes = ends - starts + gap
    begin = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=begin[1:])
    at = np.repeat(starts - begin[:-1], sizes) + np.arange(begin[-1])
    if not gap:
        return data[at], begin
    out = data[np.minimum(at, len(data) - 1)] if len(data) else np.empty(0, np.uint8)
    for i in range(gap):
        out[begin[1:] - 1 - i] = 0x20
    return out, begin


def texts_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The ranges as an Arrow array of texts."""
    out, begin = gather(data, starts, ends)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(begin), pa.py_buffer(out))


def split_runs(column: pa.Array, solid: np.ndarray, breaks: np.ndarray | None = None) -> Runs:
    """The maximal runs of ``solid`` bytes of each text; a byte of ``breaks`` ends a piece.

    Null is an empty text. A to Z are lower-cased first, so ``solid`` needs no capitals.
    """
    data, offsets = buffers(column)
    data = _LOWER[data]
    inside = solid[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begin, last = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    first = np.searchsorted(starts, offsets)
    piece = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    if breaks is not None:
        piece = piece + np.cumsum(breaks[data])[starts] if len(starts) else piece
    clean, at = gather(data, starts, ends, gap=1)
    return Runs(clean, at[:-1], at[1:] - 1, first, piece)
