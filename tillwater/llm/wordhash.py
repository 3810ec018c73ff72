"""Hashes of words and word windows, from the bytes of Arrow string columns.

No Python string is made: words are found in the column's buffer, and a word's
hash is a difference of prefix sums, so a batch costs a few nanoseconds a byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_STEP = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE * 2)
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers[:] = tables
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a column without nulls, and the offset of each text in them."""
    large = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32, len(texts) + 1, texts.offset * (8 if large else 4))
    at = at.astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a string column: hash of every word, words before each text (and all), first byte and end byte of every word, bytes."""
    raw, at = buffer_of(texts)
    space = _SPACE[raw]
    first = ~space
    first[1:] &= space[:-1]
    inner = at[:-1][at[:-1] < len(raw)]
    first[inner] = ~space[inner]
    starts = np.flatnonzero(first)
    last = ~space
    last[:-1] &= space[1:]
    closing = at[1:][at[1:] > 0] - 1
    last[closing] = ~space[closing]
    ends = np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):  # pieces of whole words, so that tables and sums stay small
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + PIECE, side="right")))
        a, b = int(starts[lo]), int(ends[hi - 1])
        power, inverse = _power_tables(b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[raw[a:b]] * power[: b - a], out=sums[1:])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        hashes[lo:hi] = (sums[e] - sums[s]) * inverse[s]
        lo = hi
    hashes += (ends - starts).astype(np.uint64) * _STEP[0]
    return mix(hashes), np.searchsorted(starts, at), starts, ends, raw


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, by its first word; shorter than ``hashes`` by size - 1."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n] * _STEP[1]
    for i in range(1, size):
        out += hashes[i : i + n] * _STEP[1 + i]
    return mix(out)


def inside(before: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of the ``n`` windows of all words lie within one text."""
    good = np.ones(max(n, 0), bool)
    for border in before[1:-1]:
        good[max(0, border - size + 1) : border] = False
    return good


def text_of_word(before: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(before) - 1), np.diff(before))
