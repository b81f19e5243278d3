"""Vectorised tokenising over Arrow text buffers.

All helpers work on the UTF-8 bytes of a whole column batch at once.  A *word*
is a maximal run of bytes other than 0x20 and 0x09-0x0D, with ASCII A-Z lower-
cased; word hashes are 64-bit and the same in every process.  Temporary memory
is a small multiple of the batch (masks) plus fixed-size windows, so one very
long text costs no more per byte than many short ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_WINDOW = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Also separates at ASCII punctuation: words of letters, digits and non-ASCII bytes only.
PUNCTUATION = _SPACE.copy()
PUNCTUATION[[c for c in range(128) if not chr(c).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODE = (_LOWER.astype(np.uint64) + U64(1)) * U64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POW = _powers(_BASE, _WINDOW)
_INV = _powers(pow(_BASE, -1, 1 << 64), _WINDOW)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with good avalanche (two multiply-xorshift rounds)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return buf, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of consecutive texts of about ``limit`` bytes; a longer text is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(buf: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte bounds of every word, and for each text the index of its first word (n+1 entries)."""
    if len(buf) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    space = gaps[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(buf), dtype=bool)
    before[0] = True
    np.logical_or(space[:-1], edge[1:-1], out=before[1:])
    after = np.empty(len(buf), dtype=bool)
    after[-1] = True
    np.logical_or(space[1:], edge[1:-1], out=after[:-1])
    word = ~space
    start = np.flatnonzero(word & before)
    end = np.flatnonzero(word & after) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each lower-cased word: a polynomial over its bytes, finalised with its length."""
    low, high, shift = (np.zeros(len(start), np.uint64) for _ in range(3))
    carry, power, inverse = (np.zeros(1, np.uint64), np.ones(1, np.uint64), np.ones(1, np.uint64))
    with np.errstate(over="ignore"):
        for base in range(0, len(buf), _WINDOW):
            part = _CODE[buf[base : base + _WINDOW]]
            part *= _POW[: len(part)]
            run = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part, out=run[1:])
            a, b = np.searchsorted(start, (base, base + _WINDOW))
            at = start[a:b] - base
            low[a:b] = carry + power * run[at]
            shift[a:b] = inverse * _INV[at]
            a, b = np.searchsorted(end, (base, base + _WINDOW), side="right")
            high[a:b] = carry + power * run[end[a:b] - base]
            carry = carry + power * run[-1]
            power = power * _POW[_WINDOW]
            inverse = inverse * _INV[_WINDOW]
        out = (high - low) * shift
        out += (end - start).astype(np.uint64) * U64(0xA0761D6478BD642F)
        return mix64(out)


def fold(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of ordered pairs of hashes."""
    with np.errstate(over="ignore"):
        return mix64(left * U64(0xE7037ED1A0B428DB) + right)


def runs(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n in lengths, concatenated."""
    total = int(lengths.sum())
    starts = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(starts, lengths)
