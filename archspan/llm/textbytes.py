"""Vectorised words, word hashes and shingles over the bytes of Arrow text columns.

Works on UTF-8 bytes: the classes used here split only at ASCII bytes, so whole
characters stay together. Buffers are handled in groups of documents of a bounded
number of bytes; a single longer document forms a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_RANDOM = np.random.Generator(np.random.PCG64(20_240_601))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Word bytes: digits, letters after lower-casing A-Z, and all bytes of non-ASCII characters.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
_VALUE = _RANDOM.integers(1, 2**63, 256, dtype=np.int64).astype(U)[_LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_ODD = (_RANDOM.integers(0, 2**62, 64, dtype=np.int64) * 2 + 1).astype(U)
BLOCK = 1 << 18
#: Documents of a group share one sort key with 52 bits of hash.
GROUP_DOCS = 4096
_MASK = U((1 << 52) - 1)
_powers = {"p": np.ones(1, U), "q": np.ones(1, U)}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["p"]) < n:
        size = max(n, BLOCK)
        for name, base in (("p", _BASE), ("q", pow(_BASE, -1, 1 << 64))):
            run = np.full(size, base, U)
            run[0] = 1
            _powers[name] = np.multiply.accumulate(run)
    return _powers["p"], _powers["q"]


def groups(column: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; null text is empty."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), lo + GROUP_DOCS, len(column))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the first word of every document (one more entry than documents)."""
    inside = WORD[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    opens[heads] = inside[heads]
    closes[tails] = inside[tails]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word, letters A-Z lower-cased."""
    out = np.empty(len(starts), U)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + BLOCK)))
        a, b = int(starts[lo]), int(ends[hi - 1])
        p, q = _power(b - a + 1)
        total = np.zeros(b - a + 1, U)
        np.cumsum(_VALUE[data[a:b]] * p[: b - a], out=total[1:])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        out[lo:hi] = (total[e] - total[s]) * q[s] + (e - s).astype(U) * _ODD[0]
        lo = hi
    return mix(out)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles as (document, 52-bit hash, count), ordered by document and hash.

    A document of fewer words than ``width`` has one shingle of all its words, one
    without words has none.
    """
    starts, ends, first = spans(data, offsets)
    h = word_hashes(data, starts, ends)
    n = np.diff(first)
    docs = np.arange(len(n))
    whole = np.maximum(n - (width - 1), 0)
    made = np.zeros(max(len(h) - width + 1, 0), U)
    for k in range(width):
        made += h[k : k + len(made)] * _ODD[1 + k]
    at = np.repeat(first[:-1], whole) + np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole)
    keys = [made[at]]
    owners = [np.repeat(docs, whole)]
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        sums = np.zeros(len(short), U)
        for k in range(width - 1):
            has = n[short] > k
            sums[has] += h[first[:-1][short[has]] + k] * _ODD[1 + k]
        keys.append(sums + n[short].astype(U) * _ODD[20])
        owners.append(short)
    owner = np.concatenate(owners).astype(U)
    key = np.sort(owner << U(52) | mix(np.concatenate(keys)) & _MASK)
    if not len(key):
        return np.zeros(0, np.int64), key, np.zeros(0, np.int64)
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = np.diff(np.r_[edge, len(key)])
    key = key[edge]
    return (key >> U(52)).astype(np.int64), key & _MASK, count
