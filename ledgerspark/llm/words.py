"""Words of UTF-8 texts and their 64-bit hashes, whole pieces at a time.

A word is a run of digits, letters and non-ASCII bytes after lower-casing A-Z. Word
hashes are differences of one running polynomial sum, so the work is a few passes over
the bytes whatever the words are.
"""

from __future__ import annotations

import numpy as np

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x41:0x5B] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True

_rng = np.random.default_rng(20240229)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_VALUE[0x41:0x5B] = BYTE_VALUE[0x61:0x7B]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def running_sum(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``sums`` with a leading 0 and the inverse powers: the hash of bytes s..e-1 is
    ``(sums[e] - sums[s]) * inverse[s]``."""
    up, down = _power_tables(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return sums, down


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words of each text."""
    is_word = WORD_BYTE[data]
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = is_word[edges]
    last[edges - 1] = is_word[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word in text order, and the number of words of each text."""
    starts, ends, counts = word_spans(data, offsets)
    sums, down = running_sum(BYTE_VALUE[data])
    return mix((sums[ends] - sums[starts]) * down[starts]), counts


def shingles(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` consecutive words and their number per text; a shorter text that is
    not empty has one, of all its words."""
    have = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    if not len(hashes):
        return hashes, have
    doc_start = np.cumsum(counts) - counts
    at = np.repeat(doc_start, have) + within_counts(have)
    size = np.repeat(np.minimum(counts, n), have)
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        there = at + k
        word = hashes[np.minimum(there, len(hashes) - 1)]
        out = np.where(size > k, mix(out * np.uint64(0x2545F4914F6CDD1D) + word + np.uint64(k + 1)), out)
    return out, have


def within_counts(counts: np.ndarray) -> np.ndarray:
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
