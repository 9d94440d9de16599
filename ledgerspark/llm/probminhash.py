"""Near-duplicate classes by ProbMinHash signatures of weighted word shingles.

A shingle that occurs w times sends out points in time, a Poisson process of rate w over the
registers in which each register is met once; a register keeps the shingle whose point comes
first. Two texts agree in a register with the probability Jaccard similarity of their weighted
shingles. Once every register of a text is filled, later points than the latest kept one
cannot change it, and its shingles stop.

Texts with equal words are one from the start. Bands of registers make buckets; in a bucket,
pairs whose signatures agree enough are joined to coarse groups (a bucket too large to look at
is joined whole, which adds no loss, only work). Coarse groups are then verified exactly, in
blocks of bounded size, on the shingles themselves; classes are the components of the links.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import global_rank
from ..session import materialize
from .components import components
from .texts import pieces
from .words import mix, shingles, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
REGISTERS = 193   # a prime, so that steps of any size meet every register once
BANDS, ROWS = 32, 6  # a pair at 0.8 shares no band with probability 6e-5
SLACK = 0.15      # below the threshold at which signatures still call for the exact check: misses a pair at 0.8 with probability 5e-7
BUCKET = 2000     # texts of one bucket compared in a task; a larger bucket is joined whole
BLOCK = 400       # texts of a coarse group in a block; two blocks are verified in one task
BROADCAST_IDS = 2_000_000


def weighted(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles of each text in rising order, how often each occurs, and their number."""
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.diff(np.append(first, len(h))), np.bincount(d[first], minlength=len(counts))


def signatures(elements: np.ndarray, weights: np.ndarray, counts: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """(texts, m) registers: the element with the earliest point; 0 for a text without elements."""
    n = len(counts)
    best, kept = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    doc = np.repeat(np.arange(n), counts)
    e, w = elements, weights.astype(np.float64)
    seed = mix(e ^ np.uint64(0xA5A5A5A55A5A5A5A))
    at = (seed % np.uint64(m)).astype(np.int64)
    step = (1 + (seed >> np.uint64(20)) % np.uint64(m - 1)).astype(np.int64)
    x = np.zeros(len(e))
    for j in range(m):
        if not len(e):
            break
        u = ((mix(seed + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        x = x - np.log(u) / (w * (m - j))
        key = doc * m + at
        sooner = np.flatnonzero(x < best[key])
        k = key[sooner]
        np.minimum.at(best, k, x[sooner])
        won = sooner[x[sooner] == best[k]]
        kept[key[won]] = e[won]
        on = np.flatnonzero(x < best.reshape(n, m).max(1)[doc])
        e, w, seed, doc, x, step = e[on], w[on], seed[on], doc[on], x[on], step[on]
        at = (at[on] + step) % m
    return kept.reshape(n, m)


def bands(registers: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    part = registers[:, : n_bands * rows].reshape(len(registers), n_bands, rows)
    out = np.broadcast_to(np.arange(1, n_bands + 1, dtype=np.uint64), part.shape[:2]).copy()
    for r in range(rows):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + part[:, :, r])
    return out.view(np.int64)


def short(registers: np.ndarray) -> np.ndarray:
    """One byte of each register: enough to estimate the similarity."""
    return (mix(registers) >> np.uint64(56)).astype(np.uint8)


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return ((many == one).mean(1) - 1 / 256) / (1 - 1 / 256)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller shares: at least the probability Jaccard similarity."""
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    both = a[0][at] == b[0]
    return float(np.minimum(a[1][at[both]] / a[1].sum(), b[1][both] / b[1].sum()).sum())


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact, of (elements in rising order, weights): for each shared element the inverse of
    the sum over all elements of the larger of the two weight ratios to it."""
    names = np.union1d(a[0], b[0])
    wa, wb = np.zeros(len(names)), np.zeros(len(names))
    wa[np.searchsorted(names, a[0])] = a[1]
    wb[np.searchsorted(names, b[0])] = b[1]
    both = (wa > 0) & (wb > 0)
    if not both.any():
        return 0.0
    # max(wa_j / wa_i, wb_j / wb_i) is the first where wa_j / wb_j is at least wa_i / wb_i.
    tilt = np.where(wb > 0, wa / np.where(wb > 0, wb, 1), np.inf)
    order = np.argsort(tilt, kind="stable")
    below = np.concatenate([[0], np.cumsum(wb[order])])
    above = np.concatenate([[0], np.cumsum(wa[order])])
    cut = np.searchsorted(tilt[order], tilt[both], "left")
    return float((1 / ((above[-1] - above[cut]) / wa[both] + below[cut] / wb[both])).sum())


def similar(a, b, threshold: float = SIMILARITY) -> bool:
    s = overlap(a, b)
    if s < threshold - 1e-9:
        return False
    return s / (2 - s) >= threshold or probability_jaccard(a, b) >= threshold - 1e-9


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _signed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``doc``, ``h`` (hash of the text), ``key`` (digest of the words), ``bands``, ``sig``; no bands without words."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column(2)):
                hashes, counts = word_hashes(data, offsets)
                sh, have = shingles(hashes, counts, SHINGLE)
                regs = signatures(*weighted(sh, have))
                place = (np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.uint64)
                full = np.flatnonzero(counts)
                starts = (np.cumsum(counts) - counts)[full]
                keys = np.zeros((hi - lo, 2), np.uint64)
                if len(full):
                    for k, salt in enumerate((0x51ED270B7F4A7C15, 0xD6E8FEB86659FD93)):
                        keys[full, k] = np.add.reduceat(mix(hashes + mix(place + np.uint64(salt))), starts)
                names = [keys[i].tobytes() if counts[i] else hashlib.blake2b(data[offsets[i] : offsets[i + 1]].tobytes(), digest_size=17).digest() for i in range(hi - lo)]
                b, s = bands(regs), short(regs)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(k).slice(lo, hi - lo) for k in (0, 1)], pa.array(names, pa.binary()),
                        pa.array([x if c else None for x, c in zip(b, counts)], pa.list_(pa.int64())), pa.array([x.tobytes() for x in s], pa.binary()),
                    ],
                    ["doc", "h", "key", "bands", "sig"],
                )

    slim = docs.where(F.col(id).isNotNull()).select(id, F.xxhash64(text), text)
    id_type = docs.schema[id].dataType.simpleString()
    return slim.mapInArrow(run, f"doc {id_type}, h long, key binary, bands array<long>, sig binary")


def _grouped(batches, keys: int):
    """Rows of equal first ``keys`` columns, from batches sorted by them."""
    now, held = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[:keys] != now:
                if held:
                    yield now, held
                now, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield now, held


def _pairs(rows: list[tuple]):
    cols = list(zip(*rows)) or [(), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])


def _coarse_links(reps: DataFrame, threshold: float) -> DataFrame:
    """Links between nodes whose texts share a band and whose signatures call for a check: in each
    bucket as few as keep the connections."""
    reps = reps.select(F.col("node").alias("doc"), "bands", "sig")
    spread = reps.where("bands IS NOT NULL").select("doc", F.explode("bands").alias("band"))
    sizes = spread.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first")).where("n > 1")
    sizes = materialize(sizes.select(F.col("band").alias("_band"), "n", "first"), "bands")
    shared = materialize(spread.join(sizes, F.col("band") == F.col("_band")).select("band", "doc", "n", "first"), "buckets")
    large = shared.where((F.col("n") > BUCKET) & (F.col("doc") != F.col("first"))).select(F.col("doc").alias("a"), F.col("first").alias("b"))

    def compare(batches):
        out = []
        for _, rows in _grouped(batches, 1):
            docs = [r[0] for r in rows]
            sig = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), -1)
            forest = Forest(len(rows))
            for i in range(len(rows) - 1):
                for j in (np.flatnonzero(estimate(sig[i], sig[i + 1 :]) >= threshold - SLACK) + i + 1).tolist():
                    if forest.join(i, j):
                        out.append((docs[i], docs[j]))
            if len(out) > 10_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    sigs = reps.select(F.col("doc").alias("_doc"), "sig")
    small = shared.where(F.col("n") <= BUCKET).join(sigs, F.col("doc") == F.col("_doc")).select("band", "doc", "sig")
    dealt = small.repartition("band").sortWithinPartitions("band", "doc")
    return dealt.mapInArrow(compare, "a long, b long").union(large).distinct()


def _verified_links(docs: DataFrame, reps: DataFrame, groups: DataFrame, id: str, text: str, threshold: float) -> DataFrame:
    """Links of nodes at or above ``threshold`` inside coarse groups, as few as keep the connections."""
    groups = materialize(groups, "groups")
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n")).select(F.col("component").alias("_c"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = groups.join(sizes, F.col("component") == F.col("_c")).select("node", "component", "blocks")
    small = placed.count() <= BROADCAST_IDS
    placed = placed.join(reps.select("node", F.col("doc").alias("_doc"), F.col("h").alias("_h")), "node")
    texts = docs.select(F.col(id).alias("_id"), F.col(text).alias("text"))
    chosen = texts.join(F.broadcast(placed) if small else placed, (F.col("_id") == F.col("_doc")) & (F.xxhash64("text") == F.col("_h")))
    chosen = chosen.select(F.col("node").alias("doc"), "text", "component", "blocks")

    def take(batches):
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column(3)):
                sh, have = shingles(*word_hashes(data, offsets), SHINGLE)
                e, w, n = weighted(sh, have)
                sig = short(signatures(e, w, n))
                at = np.cumsum(n)
                e, w = np.split(e, at[:-1]), np.split(w.astype(np.uint32), at[:-1])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).slice(lo, hi - lo) for k in range(3)], *[pa.array([x.tobytes() for x in v], pa.binary()) for v in (sig, e, w)]],
                    ["doc", "component", "blocks", "sig", "e", "w"],
                )

    vectors = chosen.select("doc", "component", "blocks", "text").mapInArrow(take, "doc long, component long, blocks int, sig binary, e binary, w binary")
    mine = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    sent = vectors.withColumn("mine", mine).withColumn("other", F.explode(others))
    sent = sent.select("component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "doc", "mine", "sig", "e", "w")
    dealt = sent.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "doc")

    def verify(batches):
        out = []
        for (_, bi, bj), rows in _grouped(batches, 3):
            docs_, side = [r[0] for r in rows], np.array([r[1] for r in rows])
            sig = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1)
            vec = [(np.frombuffer(r[3], np.uint64), np.frombuffer(r[4], np.uint32).astype(np.float64)) for r in rows]
            forest = Forest(len(rows))
            found = []
            for i in range(len(rows) - 1):
                est = estimate(sig[i], sig[i + 1 :])
                near = np.flatnonzero((est >= threshold - SLACK) & ((side[i + 1 :] != side[i]) | (bi == bj)))
                found += [(-est[k], i, int(k) + i + 1) for k in near]
            for _, i, j in sorted(found):
                if forest.find(i) != forest.find(j) and similar(vec[i], vec[j], threshold):
                    forest.join(i, j)
                    out.append((docs_[i], docs_[j]))
            if len(out) > 10_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    return dealt.mapInArrow(verify, "a long, b long")


def _nodes(texts: DataFrame) -> tuple[DataFrame, bool]:
    """``texts`` with a number per text (``node``) that rises with (``doc``, ``key``), and whether that is
    the id itself: it is for whole numbers of which none is the least id of two texts."""
    whole = texts.schema["doc"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    if whole and texts.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return texts.withColumn("node", F.col("doc").cast("long")), True
    return materialize(global_rank(texts, [F.col("doc"), F.col("key")], name="node"), "nodes"), False


def _classes(docs: DataFrame, id: str, text: str, threshold: float) -> DataFrame:
    """``id``, ``h`` (hash of the text), ``class_id``, ``n_copies``, ``head`` (the class keeps this id and text) of
    the rows with an id."""
    signed = materialize(_signed(docs, id, text), "signed")
    unique = signed.groupBy("key").agg(F.min(F.struct("doc", "h")).alias("least"), F.count(F.lit(1)).alias("n_copies"), F.first(F.struct("bands", "sig")).alias("s"))
    reps, plain = _nodes(materialize(unique.select("key", "least.*", "n_copies", "s.*"), "texts"))
    groups = components(_coarse_links(reps, threshold))
    classes = components(_verified_links(docs, reps, groups, id, text, threshold)).withColumnRenamed("node", "_node")
    named = reps.join(classes, F.col("node") == F.col("_node"), "left").withColumn("top", F.coalesce("component", "node"))
    if plain:
        named = named.withColumn("class_id", F.col("top"))
    else:
        named = named.join(reps.select(F.col("node").alias("top"), F.col("doc").alias("class_id")), "top")
    named = named.select(F.col("key").alias("_key"), "n_copies", "class_id", F.when(F.col("top") == F.col("node"), F.struct("doc", "h")).alias("kept"))
    own = F.struct("doc", "h").eqNullSafe(F.col("kept"))
    return signed.select("doc", "h", "key").join(named, F.col("key") == F.col("_key")).select(F.col("doc").alias(id), "h", "class_id", "n_copies", own.alias("head"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """``id``, ``class_id`` (the least id of its class), ``n_copies`` (rows with the same words).

    One row per row of ``docs``. Classes are the components of links between texts of at least
    ``threshold`` probability Jaccard similarity over five-word shingles, weighted by their
    counts; a text of fewer words is one shingle. Texts without words (null, empty, marks
    only) are alike only when equal. A null id takes no part and has a null class. Rows with the
    same id and differing texts may be in different classes, which then may have the same least id.
    Ids may be of any ordered type.
    """
    out = _classes(docs, id, text, threshold).select(id, "class_id", "n_copies")
    gone = docs.where(F.col(id).isNull()).select(id, F.lit(None).cast(out.schema["class_id"].dataType).alias("class_id"), F.lit(1).cast("long").alias("n_copies"))
    return out.unionByName(gone)


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class, that of the least id; columns as they were. Among texts
    of the class under that id the choice is fixed, and of equal rows one stays; rows without an id all stay."""
    classes = materialize(_classes(docs.select(id, text), id, text, threshold), "classes")
    heads = classes.where("head").groupBy(F.col(id).alias("_head"), F.col("h").alias("_h")).agg(F.count(F.lit(1)).alias("n"))
    heads = materialize(heads, "heads")
    same = (F.col(id) == F.col("_head")) & (F.xxhash64(text) == F.col("_h"))
    kept = docs.join(heads.where("n = 1"), same, "left_semi")
    repeated = heads.where("n > 1")
    if not repeated.isEmpty():
        kept = kept.unionByName(docs.join(repeated, same, "left_semi").dropDuplicates([id, text]))
    return kept.unionByName(docs.where(F.col(id).isNull()))
