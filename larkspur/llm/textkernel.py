"""Vectorised word, shingle and hash kernels over Arrow string columns.

A batch of texts is one byte buffer with row offsets. Everything here runs on
that buffer with numpy, so no Python object is made per word. Buffers are cut
into slices of about ``SLICE`` bytes (at row ends, or at white space inside a
very long row), which bounds the working memory whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
U64 = np.uint64

_rng = np.random.default_rng(20240229)
#: One random 64-bit value per byte; ASCII capitals share the value of their small letter.
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_BYTE[65:91] = _BYTE[97:123]
_WORD = np.ones(256, bool)
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_COEF = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * U64(2) + U64(1)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i below n (tables grow by doubling)."""
    size = max(SLICE, 1 << (n - 1).bit_length())
    have = max(_powers, default=0)
    if have < size:
        inverse = U64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            up = np.full(size, _BASE, np.uint64)
            up[0] = 1
            down = np.full(size, inverse, np.uint64)
            down[0] = 1
            _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if have:
            del _powers[have]
        have = size
    return _powers[have]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(32))
        x = x * U64(0xD6E8FEB86659FD93)
        x = x ^ (x >> U64(29))
        x = x * U64(0xD6E8FEB86659FD93)
        return x ^ (x >> U64(32))


def buffer_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets (n + 1); null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, values = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(raw: np.ndarray, off: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows whose bytes together are about ``size``; a longer row stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def _word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = _WORD[raw]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[off[:-1][off[:-1] < len(raw)]] = False
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _hash_slice(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a slice and the words' first bytes."""
    starts, ends = _word_spans(raw, off)
    up, down = _power_tables(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
        h = mix64(h ^ ((ends - starts).astype(np.uint64) * _COEF[15]))
    return h, starts


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased words of the rows, and the rows' word offsets."""
    hashes, counts = [], np.zeros(len(off) - 1, np.int64)
    for i, j in slices(raw, off):
        lo, hi = off[i], off[j]
        if j - i == 1 and hi - lo > 2 * SLICE:
            at = lo
            while at < hi:
                end = min(at + SLICE, hi)
                while end < hi and _WORD[raw[end]]:  # to the end of the word
                    step = np.flatnonzero(~_WORD[raw[end : min(end + SLICE, hi)]])
                    end = end + int(step[0]) if len(step) else min(end + SLICE, hi)
                h, _ = _hash_slice(raw[at:end], np.array([0, end - at]))
                hashes.append(h)
                counts[i] += len(h)
                at = end
        elif hi > lo:
            own = off[i : j + 1] - lo
            h, starts = _hash_slice(raw[lo:hi], own)
            hashes.append(h)
            counts[i:j] = np.diff(np.searchsorted(starts, own))
    bounds = np.zeros(len(off), np.int64)
    np.cumsum(counts, out=bounds[1:])
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), bounds


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of one text; fewer words make one shingle."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(n, width)
    with np.errstate(over="ignore"):
        total = hashes[: n - size + 1] * _COEF[0]
        for k in range(1, size):
            total = total + hashes[k : n - size + 1 + k] * _COEF[k]
        total = mix64(total + U64(size) * _COEF[14])
    total.sort()
    if n > size:
        total = total[np.concatenate(([True], total[1:] != total[:-1]))]
    return total
