"""Benchmark passages in training texts, found through suffix arrays of the training words.

Every piece of training text is a shard with a suffix array over its words, cut off at
the window length. The array is sparse: a position whose word pair begins no test suffix
is left out, as no search could end there. Every test suffix that is a window is searched
in it word by word: the range of array entries that agree so far is narrowed by bisection
until it is empty or holds every location. Nothing is shuffled: a document lies in one
shard, and the test windows travel to the tasks in parts of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .texts import pieces
from .words import mix, within_counts, word_hashes

WINDOW = 13
PART_BYTES = 32 << 20   # benchmark text sent to tasks at once; a larger benchmark takes several passes
SHARD_BYTES = 4 << 20   # training text of one suffix array
_FILTER_BITS = 20


class Windows:
    """Distinct windows of one part of the benchmark, and the items that hold each."""

    def __init__(self, ids: list[str], texts: list[str], n: int = WINDOW):
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        offsets = np.cumsum([0, *[len(d) for d in data]])
        hashes, counts = word_hashes(np.frombuffer(b"".join(data), np.uint8), offsets)
        hashes = np.maximum(hashes, np.uint64(1))
        have = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
        at = np.repeat(np.cumsum(counts) - counts, have) + within_counts(have)
        length = np.repeat(np.minimum(counts, n), have)
        rows = np.zeros((len(at), n + 1), np.uint64)
        rows[:, n] = length
        for k in range(n):
            there = length > k
            rows[there, k] = hashes[at[there] + k]
        self.words, which = np.unique(rows, axis=0, return_inverse=True)
        self.length = self.words[:, n].astype(np.int64)
        self.words = self.words[:, :n]
        names, item = np.unique(np.array(ids, object).astype(str) if ids else np.zeros(0, str), return_inverse=True)
        self.names = names.tolist()
        owner = np.unique(np.stack([which.ravel(), np.repeat(item.ravel(), have)], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        self.owner = owner[:, 1]
        self.owner_start = np.searchsorted(owner[:, 0], np.arange(len(self.words) + 1))
        size = 1 << _FILTER_BITS
        self.pair, self.single = np.zeros(size, bool), np.zeros(size, bool)
        one = self.length == 1
        self.single[_slot(self.words[one, 0])] = True
        if n > 1:
            self.pair[_slot_pair(self.words[~one, 0], self.words[~one, 1])] = True

    def __bool__(self) -> bool:
        return len(self.words) > 0


def _slot(a: np.ndarray) -> np.ndarray:
    return (a >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


def _slot_pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _slot((a ^ (b << np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15))


def suffix_array(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` in the order of the word sequences starting there, compared over ``depth`` words.
    Only entries still tied with a neighbour are looked at again."""
    at = at[np.argsort(words[at], kind="stable")]
    w = words[at]
    tied_next = np.concatenate([w[1:] == w[:-1], [False]]) if len(at) else np.zeros(0, bool)
    for k in range(1, depth):
        tied = tied_next.copy()
        tied[1:] |= tied_next[:-1]
        place = np.flatnonzero(tied)
        if not len(place):
            break
        here = at[place]
        group = np.cumsum(np.concatenate([[0], ~tied_next[place[:-1]]]))
        w = words[here + k]
        order = np.lexsort((w, group))
        at[place] = here[order]
        w = w[order]
        tied_next[place] = np.concatenate([(w[1:] == w[:-1]) & (group[1:] == group[:-1]), [False]])
    return at


def _bisect(words, sa, k, lo, hi, value, right: bool) -> np.ndarray:
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) >> 1
        w = words[sa[mid] + k]
        before = w <= value[open_] if right else w < value[open_]
        lo[open_[before]] = mid[before] + 1
        hi[open_[~before]] = mid[~before]


def locations(words: np.ndarray, sa: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(window, position) of every verbatim occurrence."""
    first = words[sa]
    which = np.arange(len(windows.words))
    lo = np.searchsorted(first, windows.words[:, 0], "left")
    hi = np.searchsorted(first, windows.words[:, 0], "right")
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k in range(1, windows.words.shape[1] + 1):
        found = lo < hi
        which, lo, hi = which[found], lo[found], hi[found]
        full = windows.length[which] == k
        done.append((which[full], lo[full], hi[full]))
        which, lo, hi = which[~full], lo[~full], hi[~full]
        if not len(which):
            break
        value = windows.words[which, k]
        lo, hi = _bisect(words, sa, k, lo, hi, value, False), _bisect(words, sa, k, lo, hi, value, True)
    which, lo, hi = (np.concatenate([d[i] for d in done]) for i in range(3))
    n = hi - lo
    return np.repeat(which, n), sa[np.repeat(lo, n) + within_counts(n)]


def shard_hits(data: np.ndarray, offsets: np.ndarray, windows: Windows):
    """Words per document, the maximal runs of hit words (document, first, end), and the
    (document, item) pairs with a window in common."""
    hashes, counts = word_hashes(data, offsets)
    none = np.zeros(0, np.int64)
    depth = windows.words.shape[1] if windows else 1
    if not windows or not len(hashes):
        return counts, (none, none, none), (none, none)
    # A zero ends every document, so that no sequence runs into the next one.
    start = np.cumsum(counts + 1) - counts - 1
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(hashes)) + doc
    words = np.zeros(len(hashes) + len(counts) + depth, np.uint64)
    words[place] = np.maximum(hashes, np.uint64(1))
    begins = windows.pair[_slot_pair(words[place], words[place + 1])] | windows.single[_slot(words[place])]
    sa = suffix_array(words, place[begins], depth)
    which, at = locations(words, sa, windows)
    if not len(which):
        return counts, (none, none, none), (none, none)
    size = len(words)
    edge = np.bincount(at, minlength=size) - np.bincount(at + windows.length[which], minlength=size)
    hit = np.cumsum(edge) > 0
    turn = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    first, end = turn[::2], turn[1::2]
    run_doc = np.searchsorted(start, first, "right") - 1
    at_doc = np.searchsorted(start, at, "right") - 1
    pair = np.unique(np.stack([at_doc, which], 1), axis=0)
    n = windows.owner_start[pair[:, 1] + 1] - windows.owner_start[pair[:, 1]]
    item = windows.owner[np.repeat(windows.owner_start[pair[:, 1]], n) + within_counts(n)]
    both = np.unique(np.stack([np.repeat(pair[:, 0], n), item], 1), axis=0)
    return counts, (run_doc, first - start[run_doc], end - start[run_doc]), (both[:, 0], both[:, 1])


SPANS = "_hit_spans"
ITEMS = "_hit_items"
WORDS = "_hit_words"


def _union(old: list[tuple[int, int]], new: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted([*old, *new]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", window: int = WINDOW,
         keep_text: bool = True, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` with the number of words, the spans of hit words (maximal runs, in words) and
    the sorted ids of the items with a window in the text.

    A window is ``window`` consecutive item words; an item of fewer words, but not none, is
    one window. Null and empty texts have no words and no hits; an item without id is named
    by an empty string; repeated items count once. Other columns stay as they are.
    """
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()["b"]
    n_parts = max(1, -(-size // part_bytes))
    slim = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = docs
    for p in range(n_parts):
        rows = slim.where(F.pmod(F.xxhash64("id"), F.lit(n_parts)) == p).collect()  # about part_bytes of text
        windows = Windows([r["id"] for r in rows], [r["text"] for r in rows], window)
        out = _pass(out, windows, text, p > 0, keep_text or p < n_parts - 1)
    return out


def _pass(docs: DataFrame, windows: Windows, text: str, again: bool, keep_text: bool) -> DataFrame:
    kept = [f for f in docs.schema.fields if f.name not in (SPANS, ITEMS, WORDS) and (keep_text or f.name != text)]
    span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            for lo, hi, data, offsets in pieces(batch.column(names.index(text)), SHARD_BYTES):
                counts, (doc, first, end), (item_doc, item) = shard_hits(data, offsets, windows)
                spans: list = [[] for _ in range(hi - lo)]
                items: list = [[] for _ in range(hi - lo)]
                for d, a, b in zip(doc.tolist(), first.tolist(), end.tolist()):
                    spans[d].append((a, b))
                for d, i in zip(item_doc.tolist(), item.tolist()):
                    items[d].append(windows.names[i])
                part = batch.slice(lo, hi - lo)
                if again:
                    before = part.column(names.index(SPANS)).to_pylist()
                    spans = [_union([(x["first"], x["end"]) for x in o], n) for o, n in zip(before, spans)]
                    items = [sorted({*o, *n}) for o, n in zip(part.column(names.index(ITEMS)).to_pylist(), items)]
                shown = [[{"first": a, "end": b} for a, b in s] for s in spans]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(names.index(f.name)) for f in kept], pa.array(counts, pa.int64()), pa.array(shown, span), pa.array(items, pa.list_(pa.string()))],
                    [*[f.name for f in kept], WORDS, SPANS, ITEMS],
                )

    of = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([
        *kept, T.StructField(WORDS, T.LongType()), T.StructField(SPANS, T.ArrayType(of)), T.StructField(ITEMS, T.ArrayType(T.StringType())),
    ])
    return docs.mapInArrow(run, schema)


def n_hit() -> Column:
    return F.aggregate(SPANS, F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["first"]).cast("long"))


def contaminated() -> Column:
    """At least a twentieth of the words, and at least one, lie in a benchmark window."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col(WORDS))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """``docs`` without contaminated rows; columns as they were."""
    return mark(docs, benchmark, **kw).where(~contaminated()).drop(WORDS, SPANS, ITEMS)
