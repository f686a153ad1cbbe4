"""Suffix arrays by induced sorting, and permuted common prefixes, in NumPy.

``suffix_array`` follows the induced-sorting scheme: classify every suffix as L or
S, sort the leftmost S substrings by inducing, name them, sort the string of
names one level deeper if names repeat, and induce the whole array from that
order.  All suffixes of one symbol are induced at once, bucket by bucket.  The
string of names has far more symbols than its buckets have members; such a level
is either induced suffix by suffix (``deep="scan"``, linear) or its suffixes are
ordered by doubling (``deep="double"``, the default: several times faster in
NumPy, with log(length) rounds).
"""

from __future__ import annotations

import numpy as np


def classify(t: np.ndarray) -> np.ndarray:
    """True for S suffixes (smaller than their successor).  The last symbol must be the unique smallest."""
    n = len(t)
    s = np.ones(n, dtype=bool)
    if n > 1:
        differ = np.flatnonzero(t[:-1] != t[1:])
        nxt = differ[np.searchsorted(differ, np.arange(n - 1))]
        s[:-1] = t[nxt] < t[nxt + 1]
    return s


def suffix_array(t: np.ndarray, deep: str = "double") -> np.ndarray:
    """Suffix array of an integer string whose last symbol is its unique smallest."""
    n = len(t)
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    if t.dtype != np.uint16 and t.max() < 1 << 16:
        t = t.astype(np.uint16)  # NumPy sorts 16-bit keys by counting
    s = classify(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    sigma = int(t.max()) + 1
    count = np.bincount(t, minlength=sigma)
    end = np.cumsum(count)
    induce = _induce_buckets if n >= 64 * sigma or n >= 4096 and sigma <= 512 else _induce_scan
    order = induce(t, s, lms, count, end)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    ranked = order[is_lms[order]]
    number = np.empty(n, dtype=np.int32)
    number[lms] = np.arange(len(lms), dtype=np.int32)
    which = number[ranked]
    names = _name(t, lms, ranked, which)
    by_place = np.empty(len(lms), dtype=np.int64)
    by_place[which] = names
    if len(lms) and names[-1] + 1 < len(lms):
        ranked = lms[_double(by_place) if deep == "double" and induce is _induce_buckets else suffix_array(by_place, deep)]
    return induce(t, s, ranked, count, end)


def _name(t: np.ndarray, lms: np.ndarray, ranked: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Names 0, 1, .. of the leftmost S substrings in sorted order; equal substrings share one."""
    m = len(ranked)
    if m == 0:
        return np.zeros(0, dtype=np.int64)
    length = (np.append(lms[1:], len(t) - 1) - lms + 1).astype(np.int32)[which]
    same = length[1:] == length[:-1]
    left = np.flatnonzero(same)
    k = 0
    while len(left):
        left = left[length[left] > k]
        off = t[ranked[left] + k] != t[ranked[left + 1] + k]
        same[left[off]] = False
        left = left[~off]
        k += 1
    return np.concatenate([[0], np.cumsum(~same)])


def _double(rank: np.ndarray) -> np.ndarray:
    """Suffix array of a string of names by doubling the compared length; only suffixes that still tie are sorted again."""
    n = len(rank)
    order = np.argsort(rank)
    r = rank[order]
    first = np.ones(n, dtype=bool)
    first[1:] = r[1:] != r[:-1]
    at = np.flatnonzero(first)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(at, np.diff(np.append(at, n)))
    k = 1
    while True:
        tied = ~first | np.append(~first[1:], False)
        where = np.flatnonzero(tied)
        if not len(where):
            return order
        members = order[where]
        nxt = members + k
        key = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0) + rank[members] * (n + 1)
        o = np.argsort(key)
        members, key = members[o], key[o]
        order[where] = members
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        first[where] = fresh
        start = where[fresh]
        rank[members] = np.repeat(start, np.diff(np.append(np.flatnonzero(fresh), len(key))))
        k *= 2


def _rank_in_group(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal neighbours: position within the group, group keys and group sizes."""
    first = np.ones(len(sorted_keys), dtype=bool)
    first[1:] = sorted_keys[1:] != sorted_keys[:-1]
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, len(sorted_keys)))
    return np.arange(len(sorted_keys)) - np.repeat(at, size), sorted_keys[at], size


def _induce_buckets(t, s, lms, count, end):
    """Induce a suffix array from the given order of leftmost S suffixes, a bucket at a time."""
    n = len(t)
    sa = np.full(n, -1, dtype=np.int32)
    start = end - count
    by = np.argsort(t[lms], kind="stable")
    chars = t[lms][by]
    rank, keys, size = _rank_in_group(chars)
    n_lms = np.zeros(len(end), dtype=np.int64)
    n_lms[keys] = size
    sa[end[chars] - n_lms[chars] + rank] = lms[by]
    head, buckets = start.copy(), np.flatnonzero(count)

    def put_l(batch):
        j = batch[batch > 0] - 1
        j = j[~s[j]]
        if len(j):
            c = t[j]
            o = np.argsort(c, kind="stable")
            j, c = j[o], c[o]
            rank, keys, size = _rank_in_group(c)
            sa[head[c] + rank] = j
            head[keys] += size

    for c in buckets.tolist():
        i = int(start[c])
        while i < head[c]:
            stop = int(head[c])
            put_l(sa[i:stop])
            i = stop
        if n_lms[c]:
            put_l(sa[end[c] - n_lms[c] : end[c]])
    tail = end.copy()

    def put_s(batch):
        j = batch[batch > 0] - 1
        j = j[s[j]]
        if len(j):
            c = t[j]
            o = np.argsort(c, kind="stable")
            j, c = j[o], c[o]
            rank, keys, size = _rank_in_group(c)
            sa[tail[c] - 1 - rank] = j
            tail[keys] -= size

    for c in buckets[::-1].tolist():
        i = int(end[c])
        while i > tail[c]:
            stop = int(tail[c])
            put_s(sa[stop:i][::-1])
            i = stop
        if head[c] > start[c]:
            put_s(sa[start[c] : head[c]][::-1])
    sa[0] = n - 1
    return sa


def _induce_scan(t, s, lms, count, end):
    """The same, suffix by suffix."""
    n = len(t)
    sa = [-1] * n
    tt, ss = t.tolist(), s.tolist()
    tail = end.tolist()
    for p in lms[::-1].tolist():
        c = tt[p]
        tail[c] -= 1
        sa[tail[c]] = p
    head = (end - count).tolist()
    for i in range(n):
        j = sa[i] - 1
        if j >= 0 and not ss[j]:
            c = tt[j]
            sa[head[c]] = j
            head[c] += 1
    tail = end.tolist()
    for i in range(n - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and ss[j]:
            c = tt[j]
            tail[c] -= 1
            sa[tail[c]] = j
    sa[0] = n - 1
    return np.array(sa, dtype=np.int64)


def common_prefixes(t: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Permuted LCP, cut at ``most``: for each text position, the common prefix with its predecessor in ``order``.

    ``order`` is a suffix array or the part of one that matters; other positions
    get 0.  A position whose predecessor is the one of the position before it,
    moved on by one over equal symbols, has that value minus one; only the others
    are compared, four symbols at a time.
    """
    n = len(t)
    out = np.zeros(n, dtype=np.int32)
    if len(order) < 2:
        return out
    before = np.full(n + 1, -1, dtype=np.int32)  # the last cell stands before position 0
    before[order[1:]] = order[:-1]
    place = np.flatnonzero(before[:-1] >= 0).astype(np.int32)
    there = before[place]
    follows = (there > 0) & (place > 0) & (before[place - 1] == there - 1)
    follows &= t[np.maximum(place, 1) - 1] == t[np.maximum(there, 1) - 1]
    # beyond ``most`` the true value is unknown, so a value is compared anew after ``most`` positions
    rank = np.arange(len(place), dtype=np.int32)
    start = np.maximum.accumulate(np.where(follows, 0, rank))
    fresh = ~follows | ((rank - start) % most == 0)
    padded = np.concatenate([t.astype(np.uint16), np.arange(1, 8, dtype=np.uint16) + np.uint16(60_000)])
    wide = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 4)).view(np.uint64).reshape(-1)
    value = np.zeros(len(place), dtype=np.int32)
    left = np.flatnonzero(fresh)
    a, b = place[left], there[left]
    k = 0
    while len(left) and k < 2 * most:
        x = wide[a] ^ wide[b]
        done = x != 0
        low = x[done] & (~x[done] + np.uint64(1))
        value[left[done]] = k + (np.log2(low.astype(np.float64)).astype(np.int32) // 16)
        go = ~done
        k += 4
        left, a, b = left[go], a[go] + 4, b[go] + 4
        value[left] = k
        inside = (a < n) & (b < n)
        left, a, b = left[inside], a[inside], b[inside]
    source = np.maximum.accumulate(np.where(fresh, rank, 0))
    out[place] = np.clip(value[source] - (rank - source), 0, most)
    return out
