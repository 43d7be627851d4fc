"""Suffix arrays by induced sorting, and permuted common prefixes, in array operations.

Suffixes are classified as smaller or larger than their successor. Substrings between leftmost-smaller places
are named in their order; where names repeat, the string of names is sorted recursively. From the order of
the leftmost-smaller suffixes the larger ones are induced, and from these the smaller ones. A suffix is its
characters up to the next suffix of known order, and chains of characters are ranked by doubling, so that one
pass over a bucket is one sort of integers instead of a loop over characters.
"""

from __future__ import annotations

import numpy as np


def _places(key: np.ndarray) -> np.ndarray:
    """For each key the number of smaller ones."""
    order = np.argsort(key)
    out = np.empty(len(key), np.int64)
    out[order] = _firsts(key[order])
    return out


def _firsts(key: np.ndarray) -> np.ndarray:
    """For each of sorted keys the index of the first that equals it."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return np.repeat(at, np.diff(np.append(at, len(key))))


def _chains(code: np.ndarray, end: np.ndarray, known: np.ndarray) -> np.ndarray:
    """For each place's chain of codes, up to the next end, the number of smaller chains.

    known is the rank of an end among those of its code. Equal chains so far have equal ranks; where more
    codes follow, they are ranked anew inside their group, by twice as many codes each time.
    """
    n = len(code)
    at = np.arange(n)
    last = np.flatnonzero(end)
    stop = np.repeat(last, np.diff(last, prepend=-1))
    left = stop - at
    step = 1
    if n and int(code.max()) < 1 << 10 and n < 1 << 31:
        step = 3
        key = code << 10
        for k in (1, 2):
            on = left >= k
            key[on] |= code[at[on] + k]
            key = key << 10 if k == 1 else key
        key = key << 32 | np.where(left < step, known[stop] + 1, 0)
    else:
        key = code << 32 | np.where(end, known + 1, 0)
    rank = _places(key)
    while len(on := np.flatnonzero(left >= step)):
        key = rank[on] << 32 | rank[on + step]
        order = np.argsort(key)
        key = key[order]
        rank[on[order]] += _firsts(key) - _firsts(key >> 32)
        step *= 2
    return rank


def _induce(code: np.ndarray, smaller: np.ndarray, lms: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks for the larger and for the smaller suffixes, from ranks of the leftmost-smaller ones."""
    n = len(code)
    rank = np.zeros(n, np.int64)
    rank[lms] = seeds
    larger = ~smaller
    own = np.flatnonzero(larger | lms)
    up = np.zeros(n, np.int64)
    up[own] = _chains(code[own], lms[own], rank[own])
    first = np.zeros(n, bool)
    first[1:] = larger[1:] & smaller[:-1]
    own = np.flatnonzero(smaller | first)
    end = first[own]
    end[-1] = True
    down = np.zeros(n, np.int64)
    down[own] = _chains(code[own], end, np.where(end, up[own], 0))
    return up, down


def _ordered(places: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places by their distinct ranks."""
    out = np.full(int(rank.max()) + 1 if len(rank) else 0, -1, np.int64)
    out[rank] = places
    return out[out >= 0]


def _sort(s: np.ndarray) -> np.ndarray:
    """The suffix array of integers whose last is 0 and smaller than all others."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    stop = np.append(np.flatnonzero(s[1:] != s[:-1]), n - 1)
    up = np.append(s[stop[:-1]] < s[stop[:-1] + 1], True)
    smaller = np.repeat(up, np.diff(stop, prepend=-1))
    lms = smaller.copy()
    lms[0] = False
    lms[1:] &= ~smaller[:-1]
    code = 2 * s + smaller
    starts = np.flatnonzero(lms)
    _, names = _induce(code, smaller, lms, np.zeros(len(starts), np.int64))
    order = np.argsort(names[starts])
    key = names[starts][order]
    new = np.zeros(len(key), np.int64)
    new[1:] = key[1:] != key[:-1]
    seeds = np.empty(len(starts), np.int64)
    seeds[order] = np.cumsum(new)
    if int(new.sum()) + 1 < len(starts):
        order = _sort(seeds)
        seeds[order] = np.arange(len(starts))
    up, down = _induce(code, smaller, lms, seeds)
    larger = np.flatnonzero(~smaller)
    both = np.concatenate([_ordered(larger, up[larger]), _ordered(np.flatnonzero(smaller), down[smaller])])
    codes = code[both]
    return both[np.argsort(codes.astype(np.uint16) if int(codes.max()) < 1 << 16 else codes, kind="stable")]


def suffix_array(data: bytes) -> np.ndarray:
    """The places of the suffixes of data in their order."""
    s = np.append(np.frombuffer(data, np.uint8).astype(np.int64) + 1, 0)
    return _sort(s)[1:]


def common_prefixes(data: bytes, array: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefixes, before): of the suffix at each place, the one before it in order (-1: none), and the bytes they share.

    Only irreducible places, where the bytes ahead of both suffixes differ, are compared; the others follow
    from the place ahead, whose suffixes share one byte more.
    """
    n = len(array)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    if n == 0:
        return before.copy(), before
    b = np.frombuffer(data, np.uint8)
    i = np.arange(n)
    ahead = np.where((i > 0) & (before > 0), before - 1, -1)
    start = (ahead < 0) | (b[np.maximum(i - 1, 0)] != b[ahead])
    at = np.flatnonzero(start & (before >= 0))
    raw = data + bytes(16)
    eight = np.ndarray((n + 8,), "<u8", raw, strides=(1,))
    most = n - np.maximum(at, before[at])
    got = np.zeros(len(at), np.int64)
    open_, h = np.arange(len(at)), 0
    while len(open_):
        x = eight[at[open_] + h] ^ eight[before[at[open_]] + h]
        low = (x & (~x + np.uint64(1))).astype(np.float64)
        same = np.where(x == 0, 8, (np.log2(np.maximum(low, 1)).astype(np.int64)) >> 3)
        got[open_] = h + same
        h += 8
        open_ = open_[(x == 0) & (most[open_] > h)]
    prefixes = np.full(n, -1, np.int64)
    prefixes[at] = np.minimum(got, most)
    prefixes[start & (before < 0)] = 0
    at = np.flatnonzero(start)
    since = at[np.cumsum(start) - 1]
    prefixes = np.maximum(prefixes[since] - (i - since), 0)
    prefixes[before < 0] = 0
    return prefixes, before
