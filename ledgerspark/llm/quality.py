"""Naive Bayes support vectors: a linear quality classifier over n-gram indicators.

A text's features are the different unigrams and bigrams of its tokens and trigrams of its
tokens' shapes, hashed into a fixed number of buckets. Indicators are scaled by the log
ratio of the classes' counts (over all labelled training rows) and normalised; a linear
model is fitted on them by dual coordinate descent on the hinge loss. The model is a fixed
number of weights, so scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .texts import pieces
from .words import BYTE_VALUE, WORD_BYTE, mix, running_sum

BUCKET_BITS = 18
FIT_ROWS = 10_000           # labelled rows (about) that the linear model is fitted on; counts use all
LABEL_ROWS = 1_000_000      # labels sent to every task up to here, joined by shuffle beyond
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 20
STEEPNESS = 2.0             # of the logistic curve that turns a margin into a score

_VALUE = BYTE_VALUE.copy()
_VALUE[0x41:0x5B] = np.random.default_rng(7).integers(1, 2**63, 26, dtype=np.uint64)
_KIND = np.ones(256, np.uint8)  # 0 white space, 1 marks, 2 words
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[WORD_BYTE] = 2
_UPPER = np.zeros(256, np.int64)
_UPPER[0x41:0x5B] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[0x30:0x3A] = 1


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every different feature, in order."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[data]
    turn = np.concatenate([[True], kind[1:] != kind[:-1]])
    turn[offsets[offsets < len(data)]] = True
    start = np.flatnonzero(turn)
    end = np.concatenate([start[1:], [len(data)]])
    token = kind[start] > 0
    start, end = start[token], end[token]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.searchsorted(offsets, start, "right") - 1
    sums, down = running_sum(_VALUE[data])
    word = mix((sums[end] - sums[start]) * down[start])
    size = end - start
    upper = np.add.reduceat(_UPPER[data], np.stack([start, end], 1).ravel()[: 2 * len(start) - (end[-1] == len(data))])[::2]
    digit = np.add.reduceat(_DIGIT[data], np.stack([start, end], 1).ravel()[: 2 * len(start) - (end[-1] == len(data))])[::2]
    code = 1 + (upper > 0) + 2 * ((upper == size) & (size > 1)) + 4 * (digit > 0) + 8 * (size > 24)
    shape = np.where(kind[start] == 2, mix(code.astype(np.uint64)), word)
    out = [(doc, word)]
    same = doc[1:] == doc[:-1]
    out.append((doc[1:][same], mix(word[:-1] * np.uint64(3) + word[1:] + np.uint64(1))[same]))
    same = doc[2:] == doc[:-2]
    triple = mix(mix(shape[:-2] * np.uint64(5) + shape[1:-1]) + shape[2:] + np.uint64(2))
    out.append((doc[2:][same], triple[same]))
    pair = np.concatenate([(d.astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(64 - bits)) for d, h in out])
    pair = np.unique(pair)
    return (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)


@dataclass
class Model:
    """``weight`` holds the fitted weights times the class ratios; ``square`` the squared ratios."""

    weight: np.ndarray
    square: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        doc, bucket = features(data, offsets)
        total = np.bincount(doc, self.weight[bucket], n)
        norm = np.sqrt(np.bincount(doc, self.square[bucket], n))
        margin = np.divide(total, norm, out=np.zeros(n), where=norm > 0) + self.bias
        return 1 / (1 + np.exp(-np.clip(STEEPNESS * margin, -500, 500)))


def held_out(id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit(""))) % 3 == 1


def training_labels(labels: DataFrame, id: str = "doc_id", label: str = "quality") -> DataFrame:
    """``id``, ``y``: one row per id that may be learned from. Labels other than 0 and 1 and
    missing ids are left out; of differing labels of an id the lower counts."""
    good = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull() & ~held_out(id))
    return good.groupBy(F.col(id).alias("_id")).agg(F.min(label).cast("int").alias("_y"))


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
        fit_rows: int = FIT_ROWS, cost: float = COST, seed: int = 42) -> Model:
    """Learn from the labelled rows that are not held out.

    One pass over their texts counts features per class and takes down the features of about
    ``fit_rows`` rows, picked by a hash of the id; these are fitted in one task. Without both
    classes every score is the smoothed share of label 1.
    """
    size = 1 << BUCKET_BITS
    marked = materialize(training_labels(labels, id, label), "labels")
    n = marked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_y"), F.lit(0)).alias("p")).first()
    n, n_pos = n["n"], n["p"]
    if not 0 < n_pos < n:
        share = (n_pos + 1) / (n + 2)
        return Model(np.zeros(size), np.zeros(size), float(np.log(share / (1 - share)) / STEEPNESS))
    picked = F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(1 << 40)) < F.lit(int(min(1.0, fit_rows / n) * (1 << 40)))
    side = marked.withColumn("_fit", picked)
    side = F.broadcast(side) if n <= LABEL_ROWS else side
    joined = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).join(side, "_id").select("_text", "_y", "_fit")

    def count(batches):
        totals = np.zeros((2, size), np.int64)
        rows = np.zeros(2, np.int64)
        for batch in batches:
            y_all, fit_all = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in pieces(batch.column(0)):
                doc, bucket = features(data, offsets)
                y = y_all[lo:hi]
                rows += np.bincount(y, minlength=2)
                for c in (0, 1):
                    totals[c] += np.bincount(bucket[y[doc] == c], minlength=size)
                take = np.flatnonzero(fit_all[lo:hi])
                edges = np.searchsorted(doc, np.arange(hi - lo + 1))
                if len(take):
                    yield _rows(y=y[take], ids=[bucket[edges[i] : edges[i + 1]].astype(np.int32) for i in take])
        seen = np.flatnonzero(totals.sum(0))
        yield _rows(bucket=seen, neg=totals[0, seen], pos=totals[1, seen])

    schema = "bucket int, neg long, pos long, y int, ids array<int>"
    stage = materialize(joined.mapInArrow(count, schema), "counts")
    sums = stage.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).toPandas()  # at most 2^BUCKET_BITS rows
    neg, pos = np.zeros(size), np.zeros(size)
    neg[sums["bucket"]], pos[sums["bucket"]] = sums["neg"], sums["pos"]
    p, q = pos + SMOOTHING, neg + SMOOTHING
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[(neg + pos) == 0] = 0

    def solve(batches):
        ids, y = [], []
        for batch in batches:
            ids += [np.asarray(x, np.int64) for x in batch.column(1).to_pylist()]
            y += batch.column(0).to_pylist()
        w, b = dual_coordinate_descent(ids, np.array(y), ratio, cost, seed)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()]), pa.array([b])], ["w", "b"])

    chosen = stage.where("y IS NOT NULL").select("y", "ids").repartition(1)  # about fit_rows rows
    out = chosen.mapInArrow(solve, "w binary, b double").first()
    w = np.frombuffer(out["w"], np.float64)
    return Model(w * ratio, ratio * ratio, out["b"])


def _rows(bucket=None, neg=None, pos=None, y=None, ids=None) -> pa.RecordBatch:
    n = len(bucket if bucket is not None else y)
    fill = lambda v, t: pa.nulls(n, t) if v is None else pa.array(v, t)
    return pa.RecordBatch.from_arrays(
        [fill(bucket, pa.int32()), fill(neg, pa.int64()), fill(pos, pa.int64()), fill(y, pa.int32()), fill(ids, pa.list_(pa.int32()))],
        ["bucket", "neg", "pos", "y", "ids"],
    )


def dual_coordinate_descent(ids: list[np.ndarray], label: np.ndarray, ratio: np.ndarray, cost: float, seed: int = 42) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model; rows are the normalised ratios of their features."""
    rng = np.random.default_rng(seed)
    order = sorted(range(len(ids)), key=lambda i: (len(ids[i]), ids[i][:8].tolist(), int(label[i])))  # whatever order rows arrive in
    values = [ratio[x] / max(np.sqrt(np.square(ratio[x]).sum()), 1e-12) for x in ids]
    diagonal = np.array([float(v @ v) + 1.0 for v in values])
    sign = np.where(label > 0, 1.0, -1.0)
    w, b, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(ids))
    for _ in range(EPOCHS):
        worst = 0.0
        for k in rng.permutation(len(order)):
            i = order[k]
            x, v, s = ids[i], values[i], sign[i]
            gradient = s * (float(w[x] @ v) + b) - 1.0
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), cost)
            step = new - alpha[i]
            if step:
                worst = max(worst, abs(step))
                alpha[i] = new
                w[x] += step * s * v
                b += step * s
        if worst < 1e-3:
            break
    return w, b


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``held_out``, ``score``, ``predicted``: one row per row of ``docs``. Null and
    empty texts have no features and get the score of the bias; a null id is not held out."""
    id_type = docs.schema[id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column(1)):
                s = model.scores(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [id, "score", "predicted"])

    out = docs.select(id, text).mapInArrow(run, f"`{id}` {id_type}, score double, predicted int")
    return out.select(id, held_out(id).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the rows the model rejects; columns as they were."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column(at)):
                yield batch.slice(lo, hi - lo).filter(pa.array(model.scores(data, offsets) >= 0.5))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
