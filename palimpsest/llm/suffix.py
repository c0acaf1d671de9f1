"""Suffix arrays by induced sorting, recursively, and capped permuted common prefixes."""

from __future__ import annotations

import numpy as np

from palimpsest.llm.words import hash_ranges

#: With fewer values a bucket than this, suffixes are induced one at a time, otherwise a bucket at a time by array operations.
BUCKET = 256


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of s in order; s holds integers above 0. Leftmost-smaller substrings are sorted by induction
    and named; where names repeat, the string of names is sorted in the same way."""
    s = np.append(np.asarray(s, np.int64), 0)
    n = len(s)
    if n < 3:
        return np.arange(n - 1)
    step = np.sign(np.diff(s))
    # A suffix is smaller (S) than its successor if the next value that differs is larger.
    at = np.where(step != 0, np.arange(n - 1), n)
    turn = np.minimum.accumulate(at[::-1])[::-1]
    smaller = np.append(step[np.minimum(turn, n - 2)] > 0, True)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    sizes = np.bincount(s)
    order = _induce(s, smaller, sizes, lms)
    if len(lms) > 1:
        is_lms = np.zeros(n, np.bool_)
        is_lms[lms] = True
        found = order[is_lms[order]]
        end = np.append(lms[1:] + 1, n)
        raw = s.astype("<u4").view(np.uint8)
        h = hash_ranges(raw, lms * 4, end * 4)
        rank_of = np.empty(n, np.int64)
        rank_of[lms] = np.arange(len(lms))
        k = rank_of[found]
        name = np.cumsum(np.append(0, h[k[1:]] != h[k[:-1]]))
        if name[-1] + 1 < len(lms):
            reduced = np.empty(len(lms), np.int64)
            reduced[k] = name + 1
            found = lms[suffix_array(reduced)]
        order = _induce(s, smaller, sizes, found)
    return order[1:]


def _place(values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stable order by value, counts, number within its value)."""
    order = np.argsort(values.astype(np.uint16) if k <= 1 << 16 else values, kind="stable")
    counts = np.bincount(values, minlength=k)
    start = np.cumsum(counts) - counts
    return order, counts, np.arange(len(values)) - start[values[order]]


def _induce(s: np.ndarray, smaller: np.ndarray, sizes: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes from sorted leftmost-smaller ones."""
    n, k = len(s), len(sizes)
    end = np.cumsum(sizes)
    start = end - sizes
    if n < BUCKET * k:
        return _induce_singly(s, smaller, start, end, lms)
    out = np.full(n, -1, np.int64)
    # Leftmost-smaller suffixes at the ends of their buckets.
    order, counts, number = _place(s[lms], k)
    v = s[lms][order]
    out[end[v] - counts[v] + number] = lms[order]
    first = (end - counts).tolist()
    head = start.copy()
    for c in np.flatnonzero(sizes).tolist():
        done = int(start[c])
        while True:
            stop = int(head[c])
            if done == stop:
                break
            _larger(out[done:stop], s, smaller, k, head, out)
            done = stop
        if first[c] < end[c]:
            _larger(out[first[c] : end[c]], s, smaller, k, head, out)
    # From the right: the smaller ones, leftmost ones are put anew.
    tail = end.copy()
    for c in np.flatnonzero(sizes)[::-1].tolist():
        done = int(end[c])
        while True:
            stop = int(tail[c])
            if done == stop:
                break
            _smaller(out[stop:done][::-1], s, smaller, k, tail, out)
            done = stop
        if start[c] < head[c]:
            _smaller(out[start[c] : head[c]][::-1], s, smaller, k, tail, out)
    out[0] = n - 1
    return out


def _induce_singly(s: np.ndarray, smaller: np.ndarray, start: np.ndarray, end: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The same for strings of many values."""
    order, counts, number = _place(s[lms], len(end))
    v = s[lms][order]
    placed = np.zeros(len(s), np.int64)
    placed[end[v] - counts[v] + number] = lms[order]
    out = placed.tolist()
    # The bucket of the suffix before each one; none (-1) if that is not of the kind induced. An empty place is 0.
    before = np.append(-1, np.where(smaller[:-1], -1, s[:-1])).tolist()
    head = start.tolist()
    for p in out:
        c = before[p]
        if c >= 0:
            out[head[c]] = p - 1
            head[c] += 1
    before = np.append(-1, np.where(smaller[:-1], s[:-1], -1)).tolist()
    tail = (end - 1).tolist()
    for i in range(len(out) - 1, -1, -1):
        p = out[i]
        c = before[p]
        if c >= 0:
            out[tail[c]] = p - 1
            tail[c] -= 1
    return np.array(out, np.int64)


def _larger(entries: np.ndarray, s: np.ndarray, smaller: np.ndarray, k: int, head: np.ndarray, out: np.ndarray) -> None:
    j = entries[entries > 0] - 1
    j = j[~smaller[j]]
    if len(j):
        v = s[j]
        order, counts, number = _place(v, k)
        out[head[v[order]] + number] = j[order]
        head += counts


def _smaller(entries: np.ndarray, s: np.ndarray, smaller: np.ndarray, k: int, tail: np.ndarray, out: np.ndarray) -> None:
    j = entries[entries > 0] - 1
    j = j[smaller[j]]
    if len(j):
        v = s[j]
        order, counts, number = _place(v, k)
        out[tail[v[order]] - 1 - number] = j[order]
        tail -= counts


def permuted_lcp(data: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """For each start i of bytes data: how many bytes, cap at most, suffix i shares with its predecessor in the order."""
    n = len(data)
    out = np.zeros(n, np.int64)
    phi = np.full(n, -1, np.int64)
    phi[order[1:]] = order[:-1]
    padded = np.zeros(n + cap + 8, np.uint8)
    padded[:n] = data
    eight = np.ndarray((n + cap + 1,), np.dtype("<u8"), padded.data, strides=(1,))
    live = np.flatnonzero(phi >= 0)
    for k in range(0, cap, 8):
        if not len(live):
            break
        differ = eight[live + k] ^ eight[phi[live] + k]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.frexp(low.astype(np.float64))[1].astype(np.int64) - 1 >> 3)
        out[live] += same
        live = live[differ == 0]
    return np.minimum(np.minimum(out, cap), n - np.where(phi > np.arange(n), phi, np.arange(n)))
