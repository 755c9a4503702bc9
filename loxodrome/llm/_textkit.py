"""Byte-level text helpers in numpy, shared by the Arrow operators.

Texts stay UTF-8 bytes from the Arrow buffer to the result: separators, case
folding and word hashes are whole-array operations, so no Python object is made
for a word.  Work is cut into blocks of whole texts of about ``BLOCK`` bytes, so
the memory of a worker is set by the block and the longest text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
MAX_ROWS = 256

_WRAP = 1 << 64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, _WRAP)

#: Whitespace of the word pattern [^\x20\x09-\x0D]+.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: One random 64-bit value for each byte; the seed is part of every hash below.
BYTE_VALUE = np.random.default_rng(20240607).integers(1, _WRAP, 256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        step = np.full(max(n, BLOCK + 1), base, np.uint64)
        step[0] = 1
        have = _powers[name] = np.multiply.accumulate(step)
    return have[:n]


class Rolling:
    """Hashes of any span of a byte array, from one prefix sum of b[i] * B^i mod 2^64."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * _power_table("up", _BASE, n), out=self.sums[1:])
        self.down = _power_table("down", _BASE_INV, n + 1)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Block:
    """Whole texts laid end to end. row0: index of the first in its batch; off: len+1 offsets into data."""

    row0: int
    data: np.ndarray
    off: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.off) - 1


def text_blocks(column: pa.Array, block: int = BLOCK, max_rows: int = MAX_ROWS) -> Iterator[Block]:
    """Blocks over a string column; null counts as empty. A text over ``block`` bytes is a block of its own."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, values = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, i + max_rows, max(i + 1, int(np.searchsorted(off, off[i] + block, "right")) - 1))
        yield Block(i, data[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # rows+1: index of each text's first word
    doc: np.ndarray  # text of each word


def find_words(b: Block, is_sep: np.ndarray = IS_SPACE) -> Words:
    n = len(b.data)
    inside = ~is_sep[b.data]
    edge = np.zeros(n + 1, bool)
    edge[b.off] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, b.off)
    return Words(start, end, first, np.repeat(np.arange(b.rows), np.diff(first)))


def word_hashes(b: Block, w: Words, lower: bool = False) -> np.ndarray:
    return Rolling(LOWER[b.data] if lower else b.data).spans(w.start, w.end)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i:i+k] for every i, by doubling: about 2 log2(k) passes instead of k."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    base = 0xC2B2AE3D27D4EB4F
    out: np.ndarray | None = None
    length, power, size, bit = 0, h, 1, k
    while True:
        if bit & 1:
            if out is None:
                out, length = power, size
            else:
                m = len(h) - length - size + 1
                out = out[:m] * np.uint64(pow(base, size, _WRAP)) + power[length : length + m]
                length += size
        bit >>= 1
        if not bit:
            return mix(out)
        m = len(h) - 2 * size + 1
        power = power[:m] * np.uint64(pow(base, size, _WRAP)) + power[size : size + m]
        size *= 2


def grams_inside(w: Words, k: int) -> np.ndarray:
    """Of the starts 0..words-k: those whose k words are of one text."""
    m = max(0, len(w.start) - k + 1)
    return w.doc[:m] == w.doc[k - 1 : k - 1 + m]


def covered(starts: np.ndarray, length: np.ndarray | int, n: int) -> np.ndarray:
    """Of n positions, those in one of the spans [start, start+length)."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.subtract.at(d, starts + length, 1)
    return np.cumsum(d[:n]) > 0


def per_row_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return c[off[1:]] - c[off[:-1]]


def batches(fn, source) -> Iterator[pa.RecordBatch]:
    """Applies fn to every batch that has rows."""
    for batch in source:
        if batch.num_rows:
            yield from fn(batch)
