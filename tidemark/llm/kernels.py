"""Numpy kernels over the byte buffers of Arrow string columns.

Every text operator works on one picture of a batch: the UTF-8 bytes of all its
texts end to end, the places where words begin and end, and a 64-bit number for
each word.  Words are maximal runs of bytes outside {0x20, 0x09-0x0D}; no byte of
a longer UTF-8 character falls into that set, so bytes and code points agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Odd multipliers of the polynomial and of the finishing mix (splitmix64).
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MASK = (1 << 64) - 1

#: A batch is cut into pieces of about this many bytes of text, so the working
#: arrays (some ten times as large) fit a processor's cache whatever Spark hands over.
PIECE_BYTES = 1 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(max(n, 1), dtype=np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


_POWERS: dict[str, np.ndarray] = {}


def _power_table(kind: str, n: int) -> np.ndarray:
    base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        have = _POWERS[kind] = _powers(max(n, PIECE_BYTES + 1), base)
    return have[:n]


class Piece(NamedTuple):
    """Rows [first, first + len(row_bytes) - 1) of a batch as one byte string.

    row_bytes: where each text begins in data, and the end; words: start, end and
    row of each word; row_words: index of the first word of each row, and the end.
    """

    first: int
    data: np.ndarray
    row_bytes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row_words: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.row_bytes) - 1

    def word_hashes(self) -> np.ndarray:
        """64-bit number of each word; equal words have equal numbers."""
        n = len(self.data)
        run = np.empty(n + 1, dtype=np.uint64)
        run[0] = 0
        terms = self.data.astype(np.uint64)
        terms += np.uint64(1)
        terms *= _power_table("up", n)
        np.cumsum(terms, out=run[1:])
        poly = (run[self.ends] - run[self.starts]) * _power_table("down", n + 1)[self.starts]
        return mix64(poly + (self.ends - self.starts).astype(np.uint64) * _MIX2)

    def word_rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.row_words))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null counts as empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def pieces(column: pa.Array, piece_bytes: int = PIECE_BYTES) -> Iterator[Piece]:
    """Cut a column into pieces of about piece_bytes; a longer text is a piece of its own."""
    if len(column) == 0:
        return
    raw, off = text_buffers(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(off, off[first] + piece_bytes, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        data = raw[off[first] : off[last]]
        row_bytes = off[first : last + 1] - off[first]
        yield Piece(first, data, row_bytes, *word_bounds(data, row_bytes))
        first = last


def word_bounds(data: np.ndarray, row_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words that don't cross rows, and the first word of each row."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(row_bytes), dtype=np.int64)
    inside = (data != 0x20) & (data - np.uint8(9) > 4)
    flips = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    flips = np.concatenate([[0] * bool(inside[0]), flips, [n] * bool(inside[-1])]).astype(np.int64)
    starts, ends = flips[::2], flips[1::2]
    edge = np.unique(row_bytes[1:-1])
    edge = edge[(edge > 0) & (edge < n)]
    edge = edge[inside[edge] & inside[edge - 1]]  # two words meet there
    if len(edge):
        starts = np.insert(starts, np.searchsorted(starts, edge), edge)
        ends = np.insert(ends, np.searchsorted(ends, edge), edge)
    return starts, ends, np.searchsorted(starts, row_bytes)


def gram_hashes(words: np.ndarray, row_words: np.ndarray, n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all n-word sequences inside rows, and the index of each one's first word."""
    at = np.arange(max(len(words) - n + 1, 0))
    if len(at):
        row_end = np.repeat(row_words[1:], np.diff(row_words))[: len(at)]
        at = at[at + n <= row_end]
    out = np.full(len(at), np.uint64(salt & _MASK))
    for k in range(n):
        out = (out ^ words[at + k]) * _MIX1
        out = out ^ (out >> np.uint64(29))
    return mix64(out), at
