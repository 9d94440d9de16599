"""Spelling variants: words one edit apart, found with k-d trees over their letter counts.

A replaced letter moves one letter count down and one up, an inserted letter moves one up. So
the neighbours of a word lie, in the counts of their letters, within one step up and one step
down for words of its length, and one step up for words one letter longer. Every length has a
k-d tree over count vectors. Its boxes deal the words out: a word goes to the box that holds it,
and as a query to the boxes of its own and the next length that its steps can reach. A box is
solved in one task, with a deeper tree over its own words, whose leaves are compared by counts
and then by the order of letters.

The dealing trees are fitted on at most ``FIT_WORDS`` words. They decide where work is done, not
what is found: a box that turns out large is cut into blocks of words, its queries into parts,
and each part meets each block.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .texts import strings

LEAST = 7              # code points of a word
LEAST_COUNT = 2
RATIO = 10             # a form is this many times as frequent as its variant
DIMS = 64              # letters are counted by code point modulo this; sharing a place only widens the search
LEVELS = 3             # counts up to which vectors are compared bit by bit
FIT_WORDS = 200_000    # words that the dealing trees are fitted on
FIT_LENGTH = 256       # longer words are not used for fitting; their lengths have one box each
BOX_WORDS = 4_096      # words of a block
BOX_CELLS = 4 << 20    # letters of a block, and of queries taken at once
PART_WORDS = 65_536    # queries of a part
HELD_WORDS = 100_000   # counted words a task holds before it passes them on
ROUTED = 16_384        # words dealt out at once
_LEAF = 32
_LONG = 1 << 20

_RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST)
DELETE_EVERY = 31
KEY = ["length", "box", "block", "part"]  # one search: a block of a box against a part of its queries


def noisy_words(id: str, runs: Counter) -> Counter:
    """Words of at least ``LEAST`` code points from the runs of one text, A-Z in lower case. Where
    ``DELETE_EVERY`` divides the crc32 of ``<id>:<run>``, a code point is deleted."""
    start, out = zlib.crc32(f"{id}:".encode()), Counter()
    for run, n in runs.items():
        low = run.encode().lower()  # of bytes: A-Z alone
        h = zlib.crc32(low, start)
        word = low.decode()
        if h % DELETE_EVERY == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= LEAST:
            out[word] += n
    return out


def word_counts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word``, ``n``: how often every word stands in the texts. A missing id reads as an empty one."""

    def rows(held):
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, texts in strings(batch.column(1)):
                for i, t in zip(ids[lo:hi], texts):
                    runs = Counter(_RUN.findall(t) if len(t) < _LONG else (m[0] for m in _RUN.finditer(t)))
                    held.update(noisy_words(i, runs))
                if len(held) >= HELD_WORDS:
                    yield rows(held)
                    held.clear()
        if held:
            yield rows(held)

    slim = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# --- vectors and trees

def letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), len(words[0]))


def letter_counts(codes: np.ndarray) -> np.ndarray:
    n = len(codes)
    flat = (codes % DIMS + DIMS * np.arange(n, dtype=np.int64)[:, None]).ravel()
    return np.bincount(flat, minlength=n * DIMS).reshape(n, DIMS).astype(np.int32)


def unary(counts: np.ndarray) -> np.ndarray:
    """Counts up to ``LEVELS`` as bits: what one vector has beyond another is then a bit count."""
    bits = np.concatenate([counts >= k for k in range(1, LEVELS + 1)], 1)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


@dataclass
class Tree:
    """A k-d tree. Node i holds the vectors with ``count[dim] <= cut`` in ``left[i]``, the others in
    ``right[i]``; a child below 0 is the leaf ``-1 - child``."""

    dim: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaves: list[np.ndarray]  # the vectors fitted on, by leaf

    @staticmethod
    def fit(counts: np.ndarray, leaf: int) -> Tree:
        """Boxes of about ``leaf`` vectors; equal vectors are never parted."""
        nodes: list[list[int]] = []
        leaves: list[np.ndarray] = []
        todo = [(np.arange(len(counts)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            split = _even_split(counts[rows]) if len(rows) > leaf else None
            if split is None:
                me = -1 - len(leaves)
                leaves.append(rows)
            else:
                me, (d, s) = len(nodes), split
                nodes.append([d, s, 0, 0])
                low = counts[rows, d] <= s
                todo += [(rows[~low], me, 3), (rows[low], me, 2)]
            if parent >= 0:
                nodes[parent][side] = me
        table = np.array(nodes, np.int32).reshape(-1, 4)
        return Tree(*table.T, leaves)

    def place(self, counts: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out = np.zeros(len(counts), np.int32)
        todo = [(0 if len(self.dim) else -1, np.arange(len(counts)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            low = counts[rows, self.dim[node]] <= self.cut[node]
            todo += [(self.left[node], rows[low]), (self.right[node], rows[~low])]
        return out

    def reach(self, counts: np.ndarray, up: int, down: int):
        """(leaf, rows): the vectors that come into the leaf's box by adding at most ``up`` letters and
        taking away at most ``down``."""
        none = np.zeros(len(counts), np.int32)
        lowest, highest = np.zeros(DIMS, np.int32), np.full(DIMS, np.iinfo(np.int32).max, np.int32)
        todo = [(0 if len(self.dim) else -1, np.arange(len(counts)), none, none, lowest, highest)]
        while todo:
            node, rows, added, taken, lo, hi = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -1 - node, rows
                continue
            d, s = self.dim[node], self.cut[node]
            x = counts[rows, d]
            more = taken + np.maximum(x - s, 0) - np.maximum(x - hi[d], 0)
            keep, high = more <= down, hi.copy()
            high[d] = s
            todo.append((self.left[node], rows[keep], added[keep], more[keep], lo, high))
            more = added + np.maximum(s + 1 - x, 0) - np.maximum(lo[d] - x, 0)
            keep, low = more <= up, lo.copy()
            low[d] = s + 1
            todo.append((self.right[node], rows[keep], more[keep], taken[keep], low, hi))


def _even_split(counts: np.ndarray) -> tuple[int, int] | None:
    """The letter and count that part the vectors most evenly; None if all are equal."""
    best, split = 0, None
    top = counts.max(0)
    for s in range(int(top.max())):
        below = (counts <= s).sum(0)
        even = np.minimum(below, len(counts) - below)
        d = int(even.argmax())
        if even[d] > best:
            best, split = int(even[d]), (d, s)
        if s >= LEVELS and best:
            break
    return split


# --- one box

def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` become those of ``b``, of the same length or one longer, by one edit."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(1) == 1
    ahead = np.where((same := a == b[:, :n]).all(1), n, same.argmin(1))
    back = np.where((same := (a == b[:, 1:])[:, ::-1]).all(1), n, same.argmin(1))
    return ahead + back >= n


class Box:
    """The words of one block, all of one length, ready to be searched."""

    def __init__(self, words: list[str], n: list[int]):
        self.words, self.n = words, n
        self.codes = letters(words)
        counts = letter_counts(self.codes)
        self.bits = unary(counts)
        self.tree = Tree.fit(counts, _LEAF)

    def near(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers of all pairs one edit apart; the queries have the box's length or one less."""
        down = int(codes.shape[1] == self.codes.shape[1])
        counts = letter_counts(codes)
        bits = unary(counts)
        found = [(np.zeros(0, np.int64),) * 2]
        for leaf, rows in self.tree.reach(counts, 1, down):
            inside = self.tree.leaves[leaf]
            for part in np.array_split(rows, -(-len(rows) * len(inside) // _LONG)):
                # The distance of the first words of the vectors alone leaves few pairs.
                q, x = np.nonzero(np.bitwise_count(bits[part, 0][:, None] ^ self.bits[inside, 0]) <= 1 + down)
                found.append((part[q], inside[x]))
        q, x = (np.concatenate(c) for c in zip(*found))
        close = np.bitwise_count(bits[q] ^ self.bits[x]).sum(1) <= 1 + down
        q, x = q[close], x[close]
        good = np.zeros(len(q), bool)
        step = max(1, BOX_CELLS // codes.shape[1])
        for k in range(0, len(q), step):
            good[k : k + step] = one_edit(codes[q[k : k + step]], self.codes[x[k : k + step]])
        return q[good], x[good]


class _Seen:
    """Per word the number of near words and the best of them, as (-n, word)."""

    def __init__(self):
        self.held: dict[str, list] = {}

    def add(self, word: str, other: str, n: int) -> None:
        now = self.held.get(word)
        if now is None:
            self.held[word] = [1, -n, other]
            return
        now[0] += 1
        if (-n, other) < (now[1], now[2]):
            now[1:] = -n, other

    def rows(self) -> pa.RecordBatch:
        cols = list(zip(*[(w, *x) for w, x in self.held.items()])) or [(), (), (), ()]
        self.held = {}
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "near", "m", "form"])


# --- all boxes

def _fit_trees(words: DataFrame) -> tuple[dict[int, Tree], dict[int, int]]:
    """A tree per length and the number of its first box, from at most ``FIT_WORDS`` words."""
    total = words.count()
    # The least hashes are an even sample, the same in every run.
    slots = 1 << 32
    sample = words.where((F.col("length") <= FIT_LENGTH) & (F.pmod(F.xxhash64("word"), F.lit(slots)) < slots * FIT_WORDS // max(total, 1))).select("word").limit(FIT_WORDS)
    by_length: dict[int, list[str]] = {}
    taken = 0
    for (w,) in sample.collect():
        by_length.setdefault(len(w), []).append(w)
        taken += 1
    leaf = max(1, BOX_WORDS * taken // max(total, 1))
    trees, first, at = {}, {}, 0
    for length in sorted(by_length):
        trees[length] = Tree.fit(letter_counts(letters(by_length[length])), leaf)
        first[length] = at
        at += len(trees[length].leaves)
        trees[length].leaves = []  # the sample stays on the driver
    return trees, first


def _routed(words: DataFrame, trees: dict[int, Tree], first: dict[int, int]) -> DataFrame:
    """``length`` (of the box's words), ``box``, ``query``, ``word``, ``n``: every word in its box, and as
    a query in the boxes it can reach. A length without a tree is one box."""
    none = Tree(*np.zeros((4, 0), np.int32), [])

    def deal(names: list[str], n: np.ndarray):
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(names):
            by_length.setdefault(len(w), []).append(k)
        for length, picked in by_length.items():
            step = max(1, BOX_CELLS // max(length, DIMS))
            for lo in range(0, len(picked), step):
                rows = np.array(picked[lo : lo + step])
                counts = letter_counts(letters([names[k] for k in rows]))
                own = trees.get(length, none)
                boxes = [(length, first.get(length, 0) + own.place(counts), False, rows)]
                for long, down in ((length, 1), (length + 1, 0)):
                    at = first.get(long, 0)
                    boxes += [(long, np.full(len(hit), at + leaf), True, rows[hit]) for leaf, hit in trees.get(long, none).reach(counts, 1, down)]
                for long, box, query, hit in boxes:
                    m = len(hit)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(m, long), pa.int32()), pa.array(box, pa.int32()), pa.array(np.full(m, query)), pa.array([names[k] for k in hit], pa.string()), pa.array(n[hit], pa.int64())],
                        ["length", "box", "query", "word", "n"],
                    )

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= ROUTED:
                yield from _joined(deal, held)
                held, size = [], 0
        if held:
            yield from _joined(deal, held)

    return words.select("word", "n").mapInArrow(run, "length int, box int, query boolean, word string, n long")


def _joined(deal, held):
    table = pa.Table.from_batches(held)
    if len(table):
        dealt = pa.Table.from_batches(list(deal(table.column(0).to_pylist(), table.column(1).to_numpy())))
        yield from dealt.combine_chunks().to_batches(max_chunksize=ROUTED)


def _solved(dealt: DataFrame) -> DataFrame:
    """``word``, ``near``, ``m`` (minus the count), ``form``: partial results of every block and part."""

    def run(batches):
        now, data, box, asked, seen = None, ([], []), None, ([], []), _Seen()

        def ask():
            by_length: dict[int, list[int]] = {}
            for k, w in enumerate(asked[0]):
                by_length.setdefault(len(w), []).append(k)
            for length, picked in by_length.items():
                step = max(1, BOX_CELLS // max(length, DIMS))
                for lo in range(0, len(picked), step):
                    rows = picked[lo : lo + step]
                    q, x = box.near(letters([asked[0][k] for k in rows]))
                    for k, d in zip(q.tolist(), x.tolist()):
                        word, other = asked[0][rows[k]], box.words[d]
                        seen.add(word, other, box.n[d])
                        if length < len(other):
                            seen.add(other, word, asked[1][rows[k]])

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(len(KEY))], 1)
            query = batch.column(len(KEY)).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1) | (query[1:] != query[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if a == b:
                    continue
                key = tuple(keys[a])
                words, n = (batch.column(len(KEY) + k).slice(a, b - a).to_pylist() for k in (1, 2))
                if key != now:
                    if asked[0]:
                        ask()
                    now, data, box, asked = key, ([], []), None, ([], [])
                if not query[a]:
                    data[0].extend(words)
                    data[1].extend(n)
                elif data[0]:
                    box = box or Box(*data)
                    asked[0].extend(words)
                    asked[1].extend(n)
                    if len(asked[0]) >= ROUTED:
                        ask()
                        asked = ([], [])
            if len(seen.held) >= HELD_WORDS:
                yield seen.rows()
        if asked[0]:
            ask()
        yield seen.rows()

    keyed = dealt.repartition(*KEY).sortWithinPartitions(*KEY, "query")
    return keyed.select(*KEY, "query", "word", "n").mapInArrow(run, "word string, near long, m long, form string")


def near_words(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` of the distinct words of a stored table (``word``, ``n``)."""
    words = words.withColumn("length", F.length("word"))
    trees, first = _fit_trees(words)
    routed = materialize(_routed(words, trees, first), "routed")
    # One row per box, of which there are at most as many as words fitted on (and lengths beyond them).
    size = routed.groupBy("length", "box").agg(F.count_if(~F.col("query")).alias("d"), F.count_if("query").alias("q"))
    cells = F.greatest(F.col("length"), F.lit(1))
    size = size.where("d > 0 AND q > 0").select(
        F.col("length").alias("_l"), F.col("box").alias("_b"),
        F.ceil(F.greatest(F.col("d") / BOX_WORDS, F.col("d") * cells / BOX_CELLS)).cast("int").alias("blocks"), F.ceil(F.col("q") / PART_WORDS).cast("int").alias("parts"),
    )
    size = materialize(size, "boxes")
    own = F.pmod(F.xxhash64("word"), F.when(F.col("query"), F.col("parts")).otherwise(F.col("blocks"))).cast("int")
    both = routed.join(size, (F.col("length") == F.col("_l")) & (F.col("box") == F.col("_b"))).withColumn("_own", own)
    # A query meets every block of its box, a word every part of the box's queries.
    both = both.withColumn("_other", F.explode(F.sequence(F.lit(0), F.when(F.col("query"), F.col("blocks")).otherwise(F.col("parts")) - 1)))
    block, part = F.when(F.col("query"), F.col("_other")).otherwise(F.col("_own")), F.when(F.col("query"), F.col("_own")).otherwise(F.col("_other"))
    dealt = both.select("length", "box", block.alias("block"), part.alias("part"), "query", "word", "n")
    found = _solved(dealt).groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("m", "form")).alias("_best"))
    best = F.when(-F.col("_best.m") >= ratio * F.col("n"), F.col("_best"))
    return words.select("word", "n").join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), best["form"].alias("form"), (-best["m"]).alias("form_n")
    )


def roots(links: DataFrame) -> DataFrame:
    """``word``, ``root``: where following ``form`` from a word ends. A form is ``RATIO`` times as
    frequent as its variant, so chains are short; every round doubles what a link spans."""
    links = materialize(links.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "links")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        links = materialize(links.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "links")
        if links.where("_moved").isEmpty():
            return links.select("word", "root")
        links = links.drop("_moved")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``: one row per word of ``words``, which has
    distinct ``word`` and ``n``.

    Two words are near if one inserted, deleted or replaced code point is all that differs. ``form``
    is the near word of the largest ``n`` (among equals the first in code-point order) if that is at
    least ``ratio`` times the word's own; ``root`` is the last of the chain of forms, the word itself
    without one. Empty words, and nulls in either column, are left out.
    """
    if ratio < 2:
        raise ValueError("chains of forms need a ratio of at least 2")
    stored = materialize(words.where("word <> '' AND n IS NOT NULL").select("word", F.col("n").cast("long").alias("n")), "words")
    near = materialize(near_words(stored, ratio), "near")
    last = roots(near)
    return near.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id: str = "doc_id", text: str = "text", least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """:func:`variants` of the words that stand at least ``least_count`` times in ``docs`` (see
    :func:`noisy_words`). Null texts have no words; repeated rows count each time."""
    return variants(word_counts(docs, id, text).where(F.col("n") >= least_count), ratio)
