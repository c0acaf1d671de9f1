"""Words of whole texts as arrays: boundaries and 64-bit hashes for a block of texts at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

from palimpsest.llm.common import text_buffer

#: Words end at bytes 0x20 and 0x09-0x0D only.
_IS_WORD = np.ones(256, np.bool_)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S = [np.uint64(k) for k in (30, 27, 31, 32)]
#: Longer words are hashed one at a time.
_LONG = 128


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> _S[0])) * _M2
    h = (h ^ (h >> _S[1])) * _M3
    return h ^ (h >> _S[2])


def combine(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit hash of several, order counts."""
    h = parts[0]
    for p in parts[1:]:
        h = mix(h * _M1 + p)
    return h


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts, one after another
    offsets: np.ndarray  # of the texts in data
    start: np.ndarray  # of each word in data
    end: np.ndarray
    bounds: np.ndarray  # of the texts in the words: text i has words bounds[i]:bounds[i+1]

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def hashes(self) -> np.ndarray:
        return hash_ranges(self.data, self.start, self.end)


def split(column: pa.LargeStringArray, lower: bool = False) -> Words:
    """lower: A-Z only."""
    data, offsets = text_buffer(column)
    if lower:
        data = _LOWER[data]
    inside = _IS_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]  # of texts that are not empty
    first[edges] = inside[edges]
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[ends] = inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range data[start:end]."""
    size = end - start
    h = mix(size.astype(np.uint64) + _M1)
    if not len(start):
        return h
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded.data, strides=(1,))
    long = np.flatnonzero(size > _LONG)
    left, at = np.minimum(size, _LONG), start
    live = slice(None)
    for k in range(0, int(left.max()), 8):
        if k == 8:
            live = np.flatnonzero(left > 8)
        elif k:
            live = live[left[live] > k]
        part = eight[at[live] + k] & _KEEP[np.minimum(left[live] - k, 8)]
        x = (h[live] ^ part) * _M1
        h[live] = (x ^ (x >> _S[3])) * _M2
    h = mix(h)
    if len(long):
        raw = data.tobytes()
        h[long] = [xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return h


def windows(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of each window of n words that lies in one text; position is that of its first word."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = len(h) - n + 1
    fits = np.ones(total, np.bool_)
    for b in range(1, n):
        cut = bounds[1:-1] - b
        fits[cut[(cut >= 0) & (cut < total)]] = False
    at = np.flatnonzero(fits)
    return combine(*(h[k : k + total] for k in range(n)))[at], at
