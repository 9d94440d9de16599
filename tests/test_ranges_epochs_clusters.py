"""Range tables, seeded epochs and exact clusters against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import clusters, ranges
from ledgerspark.operators.tokens import fit_edges
from ledgerspark.session import fresh_path, materialize
from ledgerspark.sources import epochs

RANGES = "lo long, hi long, label string, seq int"


def last_of(table, v):
    held = [(s, l or "") for lo, hi, l, s in table if None not in (lo, hi, s) and v is not None and lo <= v <= hi]
    return max(held)[1] or None if held else None


@pytest.mark.parametrize("seed, spread", [(1, 60), (2, 10**6), (3, 2**61)])
def test_last_range_wins(spark, seed, spread):
    r = random.Random(seed)
    table = []
    for k in range(120):
        lo = r.randint(-spread, spread)
        table.append((lo, lo + r.choice([0, 1, 5, spread // 3, -1, spread]), r.choice(["a", "b", f"l{k}"]), r.choice([k, 50])))
    table += [(None, 5, "x", 999), (0, None, "x", 999), (0, 1, "x", None), (-(2**63), -spread, "low", -5)]
    values = [x for lo, hi, *_ in table if lo is not None and hi is not None for x in (lo, lo - 1, hi, hi + 1) if abs(x) < 2**62] * 2 + [None, 0, 2**62 + 5, -(2**63)]
    flat = materialize(ranges.flatten_ranges(spark.createDataFrame(table, RANGES), hot_rows=30), "flat")
    pieces = sorted((r["lo"], r["hi"]) for r in flat.collect())
    assert all(a <= z for a, z in pieces) and all(x[1] < y[0] for x, y in zip(pieces, pieces[1:]))
    rows = spark.createDataFrame([(k, v, "old") for k, v in enumerate(values)], "k int, v long, label string")
    got = ranges.lookup_ranges(rows, "v", flat, default="none")
    assert got.columns == ["k", "v", "label"]
    assert {r["k"]: r["label"] for r in got.collect()} == {k: (v is not None and abs(v) < 2**62 and last_of(table, v)) or "none" for k, v in enumerate(values)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_ranges(spark):
    flat = ranges.flatten_ranges(spark.createDataFrame([(5, 4, "x", 1)], RANGES))
    assert flat.count() == 0 and flat.columns == ["lo", "hi", "label"]
    one = ranges.lookup_ranges(spark.range(3), "id", flat)
    assert [r["label"] for r in one.collect()] == [None] * 3


@pytest.mark.parametrize("n", [1, 2, 3, 7, 97, 100, 1000])
def test_epochs_are_permutations(spark, n):
    rows = spark.range(n).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(2)))).select("id", "epoch", epochs.slot_of(F.col("id"), n, F.col("epoch")).alias("slot"))
    got = rows.withColumn("back", epochs.row_of(F.col("slot"), n, F.col("epoch"))).collect()
    for e in range(3):
        assert sorted(r["slot"] for r in got if r["epoch"] == e) == list(range(n))
    assert all(r["back"] == r["id"] for r in got)
    if n >= 97:
        orders = {e: tuple(r["slot"] for r in sorted(got, key=lambda r: r["id"]) if r["epoch"] == e) for e in range(3)}
        assert len(set(orders.values())) == 3 and tuple(range(n)) not in orders.values()


def test_ranks_share_an_epoch_and_resume_anywhere(spark):
    n, world = 23, 4
    rows = materialize(epochs.numbered(spark.createDataFrame([(f"r{k:02}",) for k in range(n)], "name string"), [F.col("name")]), "rows")
    seen = {}
    for rank in range(world):
        m = epochs.rows_of_rank(n, rank, world)
        whole = {r["at"]: (r["epoch"], r["name"]) for r in epochs.read_window(rows, n, rank, world, 0, 3 * m + 2).collect()}
        assert sorted(whole) == list(range(3 * m + 2)) and all(whole[at][0] == at // m for at in whole)
        tail = {r["at"]: (r["epoch"], r["name"]) for r in epochs.read_window(rows, n, rank, world, m + 1, 2 * m + 1).collect()}
        assert tail == {at: x for at, x in whole.items() if at >= m + 1}
        for e in range(3):
            seen.setdefault(e, []).extend(whole[at][1] for at in range(e * m, e * m + m))
    assert all(sorted(x) == [f"r{k:02}" for k in range(n)] for x in seen.values())
    path = fresh_path(spark, "epoch")
    epochs.write_epoch(rows, path, n, 1, world, files=2)
    for rank in range(world):
        files = spark.read.parquet(path).where(F.col("rank") == rank).orderBy("position").collect()
        m = epochs.rows_of_rank(n, rank, world)
        want = epochs.read_window(rows, n, rank, world, m, m).orderBy("at").collect()
        assert [r["name"] for r in files] == [r["name"] for r in want]
    with pytest.raises(ValueError):
        epochs.rows_of_rank(5, 4, 4)
    with pytest.raises(ValueError):
        epochs.order_window(spark, 2, 3, 4, 0, 1)


def brute_cost(values, k):
    v = sorted(values)
    distinct = sorted(set(v))
    best = None
    for borders in itertools.combinations(range(1, len(distinct)), min(k, len(distinct)) - 1):
        cuts = [distinct[b] for b in borders]
        groups = np.split(np.array(v, float), np.searchsorted(v, cuts))
        cost = sum(((g - g.mean()) ** 2).sum() for g in groups)
        best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_runs_cost_the_least(seed):
    r = random.Random(seed)
    values = [r.choice([r.randint(0, 9), round(r.gauss(3, 2), 1)]) for _ in range(r.randint(1, 60))]
    values = [x for x in values if x in sorted(set(values))[:14]]
    x, n = np.unique(values, return_counts=True)
    for k in (1, 2, 3, 5):
        begin, cost = clusters.best_runs(n.astype(float), n * x, n * x * x, k)
        assert cost == pytest.approx(brute_cost(values, k), abs=1e-9) and len(begin) == min(k, len(x)) and begin == sorted(set(begin))


def test_edges_and_cells(spark):
    values = [1e9 + x for x in [0.0, 0.1, 0.2, 5.0, 5.1, 9.0, 9.3]]
    df = spark.createDataFrame([(v,) for v in values * 3 + [None, float("nan"), float("inf")]], "v double")
    edges, cost = clusters.kmeans_edges(df, "v", 3)
    assert edges == pytest.approx([1e9, 1e9 + 2.575, 1e9 + 7.1, 1e9 + 9.3]) and cost == pytest.approx(3 * brute_cost(values, 3), rel=1e-6)
    assert fit_edges(df, "v", 3, "kmeans") == edges and len(clusters.kmeans_edges(df, "v", 50)[0]) == 8
    assert clusters.kmeans_edges(df.limit(0), "v", 3) == ([], 0.0)
    r = random.Random(2)
    many = [round(r.choice([10, 50, 300]) + r.gauss(0, 6), 3) for _ in range(4000)]
    big = spark.createDataFrame([(v,) for v in many], "v double").repartition(3)
    (exact, best), (cut, near) = clusters.kmeans_edges(big, "v", 5), clusters.kmeans_edges(big, "v", 5, cells=200)
    assert best <= near <= best * 1.01 and max(abs(a - b) for a, b in zip(exact, cut)) < 1.0
