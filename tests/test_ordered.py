"""Scans over large keys give the same rows as plain windows."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerspark.operators import history, ordered
from ledgerspark.operators.ordered import find_hot_keys, global_rank, ordered_scan, quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = []
    for i in range(6000):
        user = 1 if i % 3 == 0 else (None if i % 50 == 1 else rng.randrange(2, 300))
        ts = None if rng.random() < 0.05 else rng.randrange(0, 40)  # many ties, some missing
        rows.append((i, user, ts, rng.randrange(100)))
    return spark.createDataFrame(rows, "row_id long, user long, ts long, v long").repartition(7)


def plain(df, keys):
    w = Window.partitionBy(*keys).orderBy("ts", "row_id")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.select(
        "row_id", (F.row_number().over(w) - 1).cast("bigint").alias("pos"), F.lag("v").over(w).alias("pv"), F.sum("v").over(run).alias("sv")
    )


@pytest.mark.parametrize("hot_rows", [40, 300, 1500, 10**6])
@pytest.mark.parametrize("keys", [["user"], []])
def test_scan_is_independent_of_the_row_limit(skewed, keys, hot_rows):
    got = ordered_scan(
        skewed, keys, [F.col("ts"), F.col("row_id")], position="pos", previous={"pv": "v"}, sums={"sv": "v"}, hot_rows=hot_rows
    )
    a = {tuple(r) for r in got.select("row_id", "pos", "pv", "sv").collect()}
    b = {tuple(r) for r in plain(skewed, keys).collect()}
    assert a == b


def test_hot_key_is_split_over_tasks(skewed):
    got = ordered_scan(skewed, ["user"], [F.col("ts"), F.col("row_id")], position="pos", hot_rows=200)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_part" in plan
    hot = find_hot_keys(skewed, ["user"], 200)
    assert [r["user"] for r in hot.table.collect()] == [1] and hot.count == 1


def test_many_hot_keys_are_joined_by_shuffle(skewed, monkeypatch):
    order = [F.col("ts").isNull(), F.col("ts"), F.col("row_id")]
    want = sorted(map(tuple, ordered_scan(skewed, ["user"], order, position="pos").select("row_id", "pos").collect()))
    monkeypatch.setattr(ordered, "BROADCAST_PARTS", 0)
    got = ordered_scan(skewed, ["user"], order, position="pos", hot_rows=2)
    assert sorted(map(tuple, got.select("row_id", "pos").collect())) == want


def test_no_hot_key_means_one_shuffle(skewed):
    got = ordered_scan(skewed, ["user"], [F.col("ts"), F.col("row_id")], position="pos")
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("hot_rows", [500, 10**6])
def test_global_rank(skewed, hot_rows):
    got = global_rank(skewed, [F.col("ts").isNull(), F.col("ts"), F.col("row_id")], "rank", hot_rows=hot_rows).collect()
    want = sorted(got, key=lambda r: (r["ts"] is None, r["ts"] or 0, r["row_id"]))
    assert [r["rank"] for r in want] == list(range(len(want)))


def test_parts_of_a_table_take_no_boundaries_to_the_rows(skewed):
    """An array of all boundaries beside every row grew with rows times parts."""
    got = ordered.global_prefix_sum(skewed, [F.col("ts"), F.col("row_id")], {"sv": "v"}, hot_rows=3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "_cuts" not in plan
    assert {tuple(r) for r in got.select("row_id", "sv").collect()} == {tuple(r) for r in plain(skewed, []).select("row_id", "sv").collect()}


@pytest.mark.parametrize("hot_rows", [10, 10**6])
def test_quantiles_are_exact(spark, hot_rows):
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=700), np.full(400, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    probs = [0.0, 0.1, 0.5, 0.8, 0.95, 1.0]
    assert np.allclose(quantiles(df, "x", probs, hot_rows), np.quantile(x, probs), atol=1e-12)


def test_quantiles_of_nothing(spark):
    assert quantiles(spark.createDataFrame([], "x double"), "x", [0.5]) == []


@pytest.mark.parametrize("hot_rows", [50, 10**6])
def test_gap(skewed, hot_rows):
    got = history.with_gap(skewed, ["user"], [*history.nulls_last("ts"), F.col("row_id")], "ts", hot_rows=hot_rows)
    assert got.where("time_delta_s < 0 or time_delta_s is null").count() == 0
    by_user = {}
    for r in sorted(got.collect(), key=lambda r: (r["user"] or -1, r["ts"] is None, r["ts"] or 0, r["row_id"])):
        before = by_user.get(r["user"])
        want = max(r["ts"] - before, 0) if before is not None and r["ts"] is not None else 0
        assert r["time_delta_s"] == want
        by_user[r["user"]] = r["ts"]


def test_last_n_limits_before_the_shuffle(skewed):
    for n in (3, 5000):
        got = history.last_n(skewed, ["user"], [F.col("ts"), F.col("row_id")], n)
        assert got._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2
    got = history.last_n(skewed, ["user"], [F.col("ts"), F.col("row_id")], 3)
    assert got.where("user = 1").count() == 3


@pytest.mark.parametrize("n", [1, 3, 200, 5000])
def test_last_n_of_a_large_key_is_found_in_parts(skewed, n):
    order = [F.col("ts"), F.col("row_id")]
    rows = lambda d: sorted(r["row_id"] for r in d.collect())
    got = history.last_n(skewed, ["user"], order, n, hot_rows=150)
    assert rows(got) == rows(history.last_n(skewed, ["user"], order, n)) and got.columns == skewed.columns
    assert "_cuts" in got._jdf.queryExecution().executedPlan().toString()


def test_last_n_of_short_arrays(spark):
    df = spark.createDataFrame([([1, 2],), ([1, 2, 3, 4],), ([],)], "a array<int>")
    assert [r[0] for r in df.select(history.last_n_of_array(F.col("a"), 3)).collect()] == [[1, 2], [2, 3, 4], []]
