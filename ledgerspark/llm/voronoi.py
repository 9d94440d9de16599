"""Exact nearest-neighbour join by inner product, over the Voronoi cells of pivots.

With a component added that brings every data vector to one length, the largest inner
product is the least distance, so distance bounds apply. Data and queries go to their nearest
pivot; the cells' counts and distance ranges give each query cell a distance that surely holds
enough neighbours, and, by the triangle inequality, the ring of each data cell that may hold one.
Only these rings are sent to a group of query cells, in blocks of bounded size that are solved
on their own; the blocks' best are ranked together. Scores are whole numbers and exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

SCALE = 1024
PIVOTS = 64
GROUP_QUERIES = 1024   # queries solved together
BLOCK_ROWS = 2048      # data rows of a block
BROADCAST_ROWS = 1_000_000
_FAR = float(1 << 62)


def whole_vectors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``v``: floor(scale * x) of every component as 64-bit values (beyond 2^62 cut to it).
    Rows without id, without vector or with a null or non-finite component are left out."""
    good = F.col(id).isNotNull() & F.col(vector).isNotNull()
    slim = vectors.where(good).select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    slim = slim.where(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))

    def run(batches):
        for batch in batches:
            x = batch.column(1)
            flat = np.floor(x.flatten().to_numpy() * scale)
            flat = np.clip(flat, -_FAR, _FAR).astype("<i8")
            at = np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], ["vec_id", "v"])

    return slim.mapInArrow(run, "vec_id long, v binary")


def _matrix(column, dim: int) -> np.ndarray:
    """Vectors as rows; a shorter one is filled up with zeros, which change no product."""
    out = np.zeros((len(column), dim), np.int64)
    for i, v in enumerate(column):
        x = np.frombuffer(v.as_buffer() if len(v.as_buffer()) else b"", "<i8")
        out[i, : len(x)] = x
    return out


def products(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Exact inner products; in floating point where every sum stays below 2^53."""
    if not q.size or not s.size:
        return np.zeros((len(q), len(s)), np.int64)
    if float(np.abs(q.astype(float)).max()) * float(np.abs(s.astype(float)).max()) * q.shape[1] < 2.0**53:
        return (q.astype(float) @ s.astype(float).T).astype(np.int64)
    return q @ s.T


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[np.ndarray]:
    """Per query the columns of its ``k`` highest scores, ties to the smaller id, own id left out."""
    out = []
    for row, me in zip(scores, own):
        there = np.flatnonzero(ids != me)
        if len(there) > k:
            r = row[there]
            least = np.partition(r, len(r) - k)[len(r) - k]
            there = there[r >= least]
        out.append(there[np.lexsort((ids[there], -row[there]))][:k])
    return out


class Cells:
    """Pivots, and distances in the lengthened space (where data vectors have length ``top``)."""

    def __init__(self, pivots: np.ndarray, top: float):
        self.p = pivots.astype(float)
        self.top = top
        self.rest = np.sqrt(np.maximum(top - np.square(self.p).sum(1), 0))

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        x = x.astype(float)
        square = np.square(x).sum(1)
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.top - square, 0))
        size = square + rest * rest
        d = size[:, None] + self.top - 2 * (x @ self.p.T + rest[:, None] * self.rest)
        return np.sqrt(np.maximum(d, 0))

    def between(self) -> np.ndarray:
        return self.distances(self.p, False)


def rings(cells: Cells, data: dict, queries: dict, need: int) -> list[tuple[int, int, float, float]]:
    """(query cell, data cell, least, most): the distances from the data cell's pivot at which a
    neighbour of a query in the query cell may lie. ``data``: cell -> (rows, least, most);
    ``queries``: cell -> (rows, farthest); ``need`` rows surely hold the neighbours."""
    apart = cells.between()
    slack = 1e-6 * (1 + np.sqrt(cells.top)) * 4
    out = []
    for i, (_, far) in queries.items():
        reach = sorted((far + apart[i, j] + most, n) for j, (n, _, most) in data.items())
        total, within = 0, float("inf")
        for d, n in reach:
            total += n
            if total >= need:
                within = d
                break
        for j, (_, least, most) in data.items():
            lo, hi = apart[i, j] - far - within - slack, within + far + apart[i, j] + slack
            if lo <= most and hi >= least:
                out.append((i, j, float(max(lo, 0.0)), float(hi)))
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, n_pivots: int = PIVOTS, group: int = GROUP_QUERIES, block: int = BLOCK_ROWS) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` highest inner products of each query.

    Both are frames of ``vec_id`` and ``v`` as from ``whole_vectors``. Rows with the query's id are
    its own and no candidates; a repeated candidate row appears as often as it is there; a query
    repeated with an equal vector counts once. Ties go to the smaller ``vec_id``. Without
    queries or candidates the result is empty.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    size = F.expr("octet_length(v)")
    facts = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("w")).first()
    queries = materialize(queries.distinct(), "queries")
    if not facts["n"] or queries.isEmpty():
        return spark.createDataFrame([], schema)
    dim = max(1, max(facts["w"], queries.agg(F.max(size)).first()[0]) // 8)

    def lengths(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.square(_matrix(batch.column(0), dim).astype(float)).sum(1))], ["s"])

    top = float(vectors.select("v").mapInArrow(lengths, "s double").agg(F.max("s")).first()[0])
    chosen = vectors.orderBy(F.xxhash64("v"), "vec_id").limit(n_pivots).select("v").distinct().collect()  # at most n_pivots rows
    pivots = np.unique(np.array([np.pad(np.frombuffer(r["v"], "<i8"), (0, dim - len(r["v"]) // 8)) for r in chosen]), axis=0)
    cells = Cells(pivots, top)

    def assign(query):
        def run(batches):
            for batch in batches:
                d = cells.distances(_matrix(batch.column(1), dim), query)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])], ["vec_id", "v", "cell", "d"])

        return run

    kept = "vec_id long, v binary, cell int, d double"
    data = materialize(vectors.mapInArrow(assign(False), kept), "cells")
    asked = materialize(queries.mapInArrow(assign(True), kept), "asked")
    of_data = {r["cell"]: (r["n"], r["a"], r["b"]) for r in data.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("a"), F.max("d").alias("b")).collect()}
    of_asked = {r["cell"]: (r["n"], r["b"]) for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("b")).collect()}
    ids = queries.select(F.col("vec_id").alias("_q")).distinct()
    own = vectors.join(ids, F.col("vec_id") == F.col("_q"), "left_semi").groupBy("vec_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    ring = rings(cells, of_data, of_asked, k + own)

    # Neighbouring query cells make a group; a cell of more queries makes several.
    groups, total = {}, 0
    first = np.argsort(cells.between()[0], kind="stable").tolist()
    for i in (i for i in first if i in of_asked):
        n = of_asked[i][0]
        if total % group and total % group + n > group:
            total += group - total % group
        groups[i] = (total // group, -(-n // group))
        total += n if n <= group else group * (-(-n // group))
    spread = {}
    for i, j, lo, hi in ring:
        for g in range(groups[i][0], groups[i][0] + groups[i][1]):
            a, b = spread.get((g, j), (lo, hi))
            spread[g, j] = (min(a, lo), max(b, hi))
    sent_to = spark.createDataFrame([(g, j, a, b) for (g, j), (a, b) in spread.items()], "g int, _cell int, lo double, hi double")
    sent_to = F.broadcast(sent_to) if len(spread) <= BROADCAST_ROWS else sent_to
    n_blocks = -(-facts["n"] // block)
    at = F.pmod(F.xxhash64("vec_id", "d"), F.lit(n_blocks)).cast("int")
    sent = data.join(sent_to, (F.col("cell") == F.col("_cell")) & F.col("d").between(F.col("lo"), F.col("hi"))).select("g", at.alias("block"), "vec_id", "v")
    where = spark.createDataFrame([(i, g, n) for i, (g, n) in groups.items()], "_cell int, g0 int, parts int")
    mine = asked.join(F.broadcast(where), F.col("cell") == F.col("_cell"))  # a row per pivot
    mine = mine.select((F.col("g0") + F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "vec_id", "v")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        l, r = left.combine_chunks(), right.combine_chunks()
        out = [np.zeros(0, np.int64)] * 4
        if l.num_rows and r.num_rows:
            q, s = (_matrix(t.column("v").combine_chunks() if isinstance(t.column("v"), pa.ChunkedArray) else t.column("v"), dim) for t in (l, r))
            asked_ids, ids_ = l.column("vec_id").to_numpy(), r.column("vec_id").to_numpy()
            scores = products(q, s)
            top_ = best(scores, ids_, asked_ids, k)
            row = np.repeat(np.arange(len(top_)), [len(t) for t in top_])
            col = np.concatenate(top_)
            out = [asked_ids[row], row, ids_[col], scores[row, col]]
            keys = [l.column("v")[int(i)].as_py() for i in range(l.num_rows)]
            key = [keys[i] for i in row]
        else:
            key = []
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "key": pa.array(key, pa.binary()), "vec_id": pa.array(out[2], pa.int64()), "score": pa.array(out[3], pa.int64())})

    found = mine.groupBy("g", "block").cogroup(sent.groupBy("g", "block")).applyInArrow(solve, "query_id long, key binary, vec_id long, score long")
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
