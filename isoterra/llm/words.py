"""NumPy kernels over the words of Arrow text columns: whole batches at once, no loop over words.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at a time; a longer document is a chunk of its own.
CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _table(lower: bool) -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=np.uint64) * _BASE) | np.uint64(1)
    t[[9, 10, 11, 12, 13, 32]] = 0
    if lower:
        t[65:91] = t[97:123]
    return t


_PLAIN, _LOWER = _table(False), _table(True)
_SPACE = _PLAIN == 0
_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            _powers = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_BASE, _INVERSE))
    return _powers


def is_space(data: np.ndarray) -> np.ndarray:
    """Which bytes stand between words."""
    return _SPACE[data]


class Chunk(NamedTuple):
    """Words of documents first..first+len(at)-1 of a batch."""

    first: int
    #: hash of every word
    word: np.ndarray
    #: word index at which each document begins, and the number of words at the end
    at: np.ndarray
    #: byte range of every word in data
    start: np.ndarray
    stop: np.ndarray
    data: np.ndarray


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, lower: bool = False) -> Iterator[Chunk]:
    data, offsets = text_bytes(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        j = min(j, n)
        yield _chunk(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower)
        i = j


def _chunk(first: int, data: np.ndarray, offsets: np.ndarray, lower: bool) -> Chunk:
    if not len(data):
        none = np.zeros(0, np.int64)
        return Chunk(first, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none, data)
    inside = ~_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    begins[heads] = inside[heads]
    ends[tails] = inside[tails]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    at = np.searchsorted(start, offsets)
    if not len(start):
        return Chunk(first, np.zeros(0, np.uint64), at, start, stop, data)
    power, inverse = _grown(len(data) + 1)
    with np.errstate(over="ignore"):
        value = (_LOWER if lower else _PLAIN)[data] * power[: len(data)]
        word = np.add.reduceat(value, start) * inverse[start]
        return Chunk(first, mix(word + (stop - start).astype(np.uint64)), at, start, stop, data)


def sequences(word: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position; the last k - 1 positions have none."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if k <= 8:
            h = word[:n].copy()
            for i in range(1, k):
                h = h * _BASE + word[i : i + n]
            return mix(h + np.uint64(k))
        power, inverse = _grown(len(word) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * power[: len(word)])])
        return mix((total[k:] - total[:-k]) * inverse[:n] + np.uint64(k))


def shingle_sets(column: pa.Array, k: int, lower: bool) -> Iterator[np.ndarray]:
    """For every document its distinct k-word shingles as sorted hashes; a shorter text is one shingle, none is none."""
    for c in chunks(column, lower):
        s = sequences(c.word, k)
        for a, b in zip(c.at[:-1].tolist(), c.at[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(s[a : b - k + 1])
            elif b > a:
                yield sequences(c.word[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)
