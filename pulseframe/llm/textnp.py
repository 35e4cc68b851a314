"""Vectorised text primitives over the flat byte buffers of Arrow string columns."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc

import numpy as np
import pyarrow as pa


def tidy(f):
    """A partition function that gives its memory back to the system when its task ends; workers live on."""

    @functools.wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def _splitmix(n: int, seed: int) -> np.ndarray:
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODE = _splitmix(256, 77)
_BASE = np.uint64(0xD6E8FEB86659FD95)  # 5 mod 8
_power = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the base, kept for the next call."""
    global _power
    if len(_power) < n:
        p = np.full(max(n, 4096), _BASE, np.uint64)
        p[0] = 1
        _power = np.cumprod(p, dtype=np.uint64)
    return _power


def column(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null counts as empty. offsets[0] is 0."""
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    if a.null_count:
        a = a.fill_null("" if pa.types.is_string(a.type) or pa.types.is_large_string(a.type) else b"")
    wide = pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type)
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, o, d = a.buffers()
    off = np.frombuffer(o, np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = np.frombuffer(d, np.uint8) if d is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slabs(off: np.ndarray, limit: int):
    """Row ranges (i, j) of about `limit` bytes; a longer text has a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that don't cross a row's end."""
    n = len(mask)
    first = np.zeros(n + 1, bool)
    first[off] = True
    a, b = mask.copy(), mask.copy()
    a[1:] &= ~mask[:-1] | first[1:n]
    b[:-1] &= ~mask[1:] | first[1:n]
    return np.flatnonzero(a), np.flatnonzero(b) + 1


def owner(off: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The row that holds each start."""
    return np.searchsorted(off, starts, "right") - 1


def within(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pieces of these lengths laid end to end: each one's first place, each element's place in its piece."""
    ends = np.cumsum(lens)
    first = ends - lens
    return first, np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(first, lens)


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces' bytes end to end, each one's first place, each byte's place in its piece."""
    lens = ends - starts
    first, at = within(lens)
    return data[np.repeat(starts, lens) + at], first, at


def piece_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each (not empty) piece of the bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    flat, first, at = gather(data, starts, ends)
    v = BYTE_CODE[flat]
    v *= powers(int((ends - starts).max()) + 1)[at]
    return mix(np.add.reduceat(v, first))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingles(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the set of its k-word shingles as sorted fingerprints: (values, their offsets by row).

    Words are runs of other bytes than white space, A-Z lower-cased; a row of fewer than k words is one shingle.
    """
    low = LOWER[data]
    s, e = runs(~SPACE[low], off)
    n = len(off) - 1
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    h, row = piece_hash(low, s, e), owner(off, s)
    cnt = np.bincount(row, minlength=n)
    first = np.cumsum(cnt) - cnt
    at = np.arange(len(h)) - first[row]
    left = cnt[row] - at
    keep = (left >= k) | (at == 0)
    width = np.minimum(left, k)[keep].astype(np.uint64)
    p = np.flatnonzero(keep)
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    v = mix(width + np.uint64(0x51ED27))
    for j in range(k):
        inside = (width > j).astype(np.uint64)
        v = mix((v ^ (padded[p + j] * inside)) + np.uint64(j + 1))
    r = row[p]
    order = np.lexsort((v, r))
    v, r = v[order], r[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    v, r = v[new], r[new]
    return v, np.concatenate([[0], np.cumsum(np.bincount(r, minlength=n))]).astype(np.int64)
