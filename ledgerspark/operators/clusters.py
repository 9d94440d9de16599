"""Exact one-dimensional k-means over counted values.

On a line the best clusters are runs of neighbouring values, so the least total squared distance is
found by dynamic programming over the sorted distinct values: the best cost of the first j values in
c runs is the least, over the start i of the last run, of the best cost of i values in c - 1 runs plus
the run's own. The best start does not fall as j rises, so each layer is solved by halving, in m log m.

Spark counts the values. Up to ``CELLS`` distinct ones the result is exact. Beyond that, neighbouring
values are gathered in cells, each with its count, sum and sum of squares, and runs are made of whole
cells. A cell holds at most 2 / CELLS of the rows (or one value) and spans at most 2 / CELLS of the
values' range. The border between two best runs lies half-way between their centres; moving it to the end of
its cell costs at most 2 x the cell's rows x its span x the distance of the centres.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ordered import HOT_ROWS, global_prefix_sum

CELLS = 65_536  # cells that come to the driver


def run_costs(w: np.ndarray, s1: np.ndarray, s2: np.ndarray):
    """The cost of cells i..j-1 as one run, from prefix sums of weight, sum and sum of squares."""
    p0, p1, p2 = (np.concatenate([[0.0], np.cumsum(x)]) for x in (w, s1, s2))

    def cost(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n, a = p0[j] - p0[i], p1[j] - p1[i]
        return np.maximum(p2[j] - p2[i] - np.divide(a * a, n, out=np.zeros_like(a), where=n > 0), 0.0)

    return cost


def _layer(best: np.ndarray, cost, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Best cost and start of the last run for every number of cells j > ``least``, all middle points of
    one halving at once."""
    m = len(best) - 1
    out, start = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
    lo, hi = np.array([least + 1]), np.array([m])          # unsolved stretches of j
    a, z = np.array([least]), np.array([m - 1])            # where their starts lie
    while len(lo):
        mid = (lo + hi) // 2
        last = np.minimum(z, mid - 1)
        size = last - a + 1
        at = np.cumsum(size) - size
        i = np.repeat(a - at, size) + np.arange(int(size.sum()))
        total = best[i] + cost(i, np.repeat(mid, size))
        least_of = np.minimum.reduceat(total, at)
        hit = np.flatnonzero(total == np.repeat(least_of, size))
        first = hit[np.searchsorted(hit, at)]
        out[mid], start[mid] = least_of, i[first]
        left, right = lo < mid, mid < hi
        lo, hi, a, z = (
            np.concatenate([lo[left], mid[right] + 1]), np.concatenate([mid[left] - 1, hi[right]]),
            np.concatenate([a[left], start[mid[right]]]), np.concatenate([start[mid[left]], z[right]]),
        )
    return out, start


def best_runs(w: np.ndarray, s1: np.ndarray, s2: np.ndarray, k: int) -> tuple[list[int], float]:
    """Where the runs of the least total cost begin (the first at 0), and that cost. At most ``k`` runs, as
    many as there are cells; among equal costs borders as far to the left as may be."""
    m = len(w)
    k = min(k, m)
    if not k:
        return [], 0.0
    cost = run_costs(w, s1, s2)
    best = cost(np.zeros(m + 1, np.int64), np.arange(m + 1))
    starts = []
    for c in range(1, k):
        best, start = _layer(best, cost, c)
        starts.append(start)
    total, j, borders = float(best[m]), m, []
    for start in reversed(starts):
        j = int(start[j])
        borders.append(j)
    return [0, *reversed(borders)], total


def value_cells(df: DataFrame, column: str, cells: int = CELLS, hot_rows: int = HOT_ROWS) -> tuple[np.ndarray, ...]:
    """Rising cells of the known, finite values: first value, last value, weight, sum, sum of squares.
    One value each while there are at most ``cells``, else cut by weight and by value. Sums are taken about
    the mean, so that large values of small spread keep their digits."""
    x = F.col(f"`{column}`").cast("double")
    known = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    counts = materialize(df.where(known).groupBy((x + 0.0).alias("x")).agg(F.count(F.lit(1)).alias("n")), "values")
    facts = counts.agg(
        F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min("x").alias("lo"), F.max("x").alias("hi"),
    ).first()
    if not facts["m"]:
        return tuple(np.zeros(0) for _ in range(5)) + (0.0,)
    if facts["m"] <= cells:
        cell = F.col("x")
    else:
        counts = global_prefix_sum(counts, [F.col("x")], {"_to": "n"}, hot_rows=hot_rows)
        half, span = cells // 2, max(facts["hi"] - facts["lo"], 5e-324)
        cell = F.struct(F.floor((F.col("_to") - 1) * half / facts["n"]), F.least(F.floor((F.col("x") - facts["lo"]) / span * (half - 1)), F.lit(half - 1)))
    d = F.col("x") - facts["mean"]
    rows = counts.groupBy(cell.alias("c")).agg(
        F.min("x").alias("a"), F.max("x").alias("z"), F.sum("n").alias("w"), F.sum(d * F.col("n")).alias("s1"), F.sum(d * d * F.col("n")).alias("s2")
    )
    got = rows.orderBy("a").drop("c").toPandas()  # at most ``cells`` rows
    return tuple(got[c].to_numpy(float) for c in ("a", "z", "w", "s1", "s2")) + (float(facts["mean"]),)


def kmeans_edges(df: DataFrame, column: str, bins: int, cells: int = CELLS) -> tuple[list[float], float]:
    """Bin edges half-way between the centres of the best ``bins`` clusters, the ends being the least and the
    largest value, and the clusters' cost. Fewer distinct values give fewer bins; none give no edges."""
    a, z, w, s1, s2, mean = value_cells(df, column, cells)
    begin, cost = best_runs(w, s1, s2, bins)
    if not begin:
        return [], 0.0
    centres = np.add.reduceat(s1, begin) / np.add.reduceat(w, begin) + mean
    return [float(a[0]), *((centres[1:] + centres[:-1]) / 2).tolist(), float(z[-1])], cost
