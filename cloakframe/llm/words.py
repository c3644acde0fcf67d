"""Words and word windows of many texts at once, as numpy arrays inside tasks.

A block of texts is one UTF-8 buffer with row offsets, as Arrow holds it. Words are found by the
class of each byte (bytes of 0x80 and above belong to words), hashed with a polynomial over
their bytes and mixed; every step is a handful of array operations over the whole block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a single longer text is a block of its own.
BLOCK_BYTES = 500_000

_SPACES = [0x20, *range(0x09, 0x0E)]
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[_SPACES] = False
LETTERS_DIGITS = np.zeros(256, bool)
LETTERS_DIGITS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Multipliers of two independent hashes; odd, so that they have inverses modulo 2**64.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of MurmurHash3."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    known = _POWERS.get(base)
    if known is None or len(known[0]) < n:
        n = 1 << max(19, (n - 1).bit_length())
        up = np.full(n, base, np.uint64)
        down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        known = _POWERS[base] = np.cumprod(up), np.cumprod(down)
    return known


@dataclass
class Words:
    """Words of a block: byte ranges, and for row r the words ``first[r]:first[r + 1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.first))

    def hashes(self, which: int = 0) -> np.ndarray:
        base = _BASES[which]
        up, down = _powers(base, len(self.data) + 1)
        sums = np.empty(len(self.data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((self.data + np.uint64(1)) * up[: len(self.data)], out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * down[self.start]
        return mix(h ^ ((self.end - self.start).astype(np.uint64) << np.uint64(40)))

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def joined(self, row: int, keep: np.ndarray | None = None) -> bytes:
        """Words of a row with one space between; ``keep`` marks words of the whole block."""
        lo, hi = self.first[row], self.first[row + 1]
        start, end = self.start[lo:hi], self.end[lo:hi]
        if keep is not None:
            start, end = start[keep[lo:hi]], end[keep[lo:hi]]
        raw = self.data.data
        return b" ".join([raw[a:b] for a, b in zip(start.tolist(), end.tolist())])


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and its row offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(at), np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def find_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    inside = is_word[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64))
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    edges = offsets[:-1]
    before[edges[edges < len(data)]] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    last = offsets[1:]
    after[last[last > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def blocks(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of each piece take about BLOCK_BYTES."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(False)
        total = np.cumsum(size)
        lo = 0
        while lo < batch.num_rows:
            done = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, done + BLOCK_BYTES, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def words_of(batch: pa.RecordBatch, column: str, is_word=NOT_SPACE, lower=False) -> Words:
    data, offsets = buffer_of(batch.column(column))
    if lower:
        data = LOWER[data]
    return find_words(data, offsets, is_word)


def window_hashes(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words, and the word each begins at; none crosses a row."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        total = total * np.uint64(_BASES[1]) + h[j : n - k + 1 + j]
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)  # words to the end of the row
    at = np.flatnonzero(left[: n - k + 1] >= k)
    return mix(total[at]), at


def text_arrays(values: list[bytes | str]) -> pa.Array:
    return pa.array(values, pa.string())
