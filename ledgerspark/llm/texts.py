"""Views on the texts of Arrow batches, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20  # bytes of text worked on at once; a longer single text is a piece of its own


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, end, data, offsets)``: rows ``first`` to ``end`` as UTF-8 bytes, text ``i`` at
    ``data[offsets[i]:offsets[i + 1]]``. Nulls read as empty texts."""
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, starts, body = column.buffers()
    at = np.frombuffer(starts, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def strings(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, list[str]]]:
    """``(first, end, texts)`` in pieces of bounded size; nulls read as empty texts."""
    if not len(column):
        return
    if column.null_count:
        column = pc.fill_null(column, "")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    lo, n = 0, len(column)
    while lo < n:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield lo, hi, column.slice(lo, hi - lo).to_pylist()
        lo = hi


def rows_of(counts: np.ndarray) -> np.ndarray:
    """The row number of each of ``counts[i]`` entries."""
    return np.repeat(np.arange(len(counts)), counts)


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. inside each run of ``counts[i]`` entries."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
