"""Suffix arrays by induced sorting, and permuted common prefixes, in array steps.

Induced sorting goes through the buckets of first symbols; here the entries of a bucket are
taken a batch at a time: a batch is what the bucket holds so far, and only equal symbols in a
row make a bucket feed itself. Strings of leftmost-smaller substrings are sorted by the same
method; a string with too many different symbols for that is ranked by doubling instead.
"""

from __future__ import annotations

import numpy as np

SYMBOLS_A_BUCKET = 48  # with fewer symbols to a bucket, doubling is faster than going through buckets


def _classes(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """True for suffixes smaller than their successor, and the leftmost ones of each run."""
    end = np.append(np.flatnonzero(s[1:] != s[:-1]), len(s) - 1)
    small = np.append(s[end[:-1]] < s[end[:-1] + 1], True)
    is_small = np.repeat(small, np.diff(np.concatenate([[-1], end])))
    return is_small, np.flatnonzero(is_small[1:] & ~is_small[:-1]) + 1


def _ranks_in_runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a sorted array: the different values, how many of each, and each entry's rank among equals."""
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    n = np.diff(np.append(first, len(x)))
    return x[first], n, np.arange(len(x)) - np.repeat(first, n)


def _induce(s, is_small, order, sizes) -> np.ndarray:
    """The suffix array that follows from ``order``, the leftmost-smaller positions as sorted so far."""
    sa = np.full(len(s), -1, np.int64)
    end = np.cumsum(sizes)
    head, tail = end - sizes, end.copy()
    values, n, rank = _ranks_in_runs(s[order])
    marks = np.zeros(len(sizes), np.int64)
    marks[values] = n
    sa[np.repeat(tail[values] - n, n) + rank] = order

    def feed(batch, want_small):
        j = batch - 1
        j = j[j >= 0]
        j = j[is_small[j] == want_small]
        if not len(j):
            return
        at = np.argsort(s[j], kind="stable")
        values, n, rank = _ranks_in_runs(s[j[at]])
        if want_small:
            sa[np.repeat(tail[values] - 1, n) - rank] = j[at]
            tail[values] -= n
        else:
            sa[np.repeat(head[values], n) + rank] = j[at]
            head[values] += n

    for c in np.flatnonzero(sizes):
        lo = end[c] - sizes[c]
        while lo < head[c]:
            lo, batch = head[c], sa[lo : head[c]]
            feed(batch, False)
        if marks[c]:
            feed(sa[end[c] - marks[c] : end[c]], False)
    for c in np.flatnonzero(sizes)[::-1]:
        hi = end[c]
        while hi > tail[c]:
            hi, batch = tail[c], sa[tail[c] : hi][::-1]
            feed(batch, True)
        feed(sa[end[c] - sizes[c] : head[c]][::-1], True)
    return sa


def _names(s, lms, order) -> tuple[np.ndarray, int]:
    """Rank of each leftmost-smaller substring, in text order; equal substrings share a rank."""
    place = np.zeros(len(s), np.int64)
    place[lms] = np.arange(len(lms))
    span = np.append(np.diff(lms), 0)
    a, b = order[1:], order[:-1]
    la, lb = span[place[a]], span[place[b]]
    same = (la == lb) & (la > 0)
    left = np.flatnonzero(same)
    k = 0
    while len(left):
        equal = s[a[left] + k] == s[b[left] + k]
        same[left[~equal]] = False
        left = left[equal]
        left = left[la[left] > k]
        k += 1
    rank = np.concatenate([[0], np.cumsum(~same)])
    out = np.zeros(len(lms), np.int64)
    out[place[order]] = rank
    return out, int(rank[-1]) + 1


def _doubling(s: np.ndarray) -> np.ndarray:
    rank, n, k = s.astype(np.int64), len(s), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (int(after.max()) + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions in the order of the suffixes. ``s`` ends with a 0 that occurs nowhere else."""
    if len(s) < 3:
        return np.argsort(s, kind="stable")
    sizes = np.bincount(s)
    if np.count_nonzero(sizes) * SYMBOLS_A_BUCKET > len(s) and len(sizes) > 512:
        return _doubling(s)
    is_small, lms = _classes(s)
    first = lms[np.argsort(s[lms], kind="stable")]
    sa = _induce(s, is_small, first, sizes)
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    names, n = _names(s, lms, order)
    if n < len(lms):
        order = lms[suffix_array(names)]
    return _induce(s, is_small, order, sizes)


def permuted_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For every position, the length it shares with the suffix before it in ``sa``.

    Only positions whose predecessor symbols differ are compared; elsewhere the length is one
    less than at the position to the left."""
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    fresh = (before <= 0) | (at == 0)
    fresh[1:] |= s[at[1:] - 1] != s[before[1:] - 1]
    i = np.flatnonzero(fresh & (before >= 0))
    j = before[i]
    length = np.zeros(n, np.int64)
    step = 8
    # The last symbol occurs once, so no two suffixes agree beyond it.
    data = np.concatenate([s, np.zeros(step, s.dtype)])
    live = np.arange(len(i))
    shared = np.zeros(len(i), np.int64)
    while len(live):
        a, b = i[live] + shared[live], j[live] + shared[live]
        equal = np.ones(len(live), np.int64)
        gain = np.zeros(len(live), np.int64)
        for k in range(step):
            equal &= data[a + k] == data[b + k]
            gain += equal
        shared[live] += gain
        live = live[gain == step]
    length[i] = shared
    # length + position never falls, and is constant between fresh positions.
    known = np.where(fresh, length + at, -1)
    return np.maximum.accumulate(known) - at
