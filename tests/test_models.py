"""Metrics, losses, samples, vectors and models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import metrics, ml, sampling, vectors
from ledgerspark.operators.metrics import LOSSES, build_loss

NAMES = [*LOSSES, "pauc_sigmoid"]
LOGITS = [(0.25, 0.75, 1), (4.0, -6.0, 0), (-0.125, -3.5, 0), (-7.0, 1.25, 1)]


def frame(spark, amounts=(0.0, 100.0, 0.0, 500.0), labels=None):
    rows = [(a, b, (labels or [r[2] for r in LOGITS])[i], float(amounts[i])) for i, (a, b, _) in enumerate(LOGITS)]
    return spark.createDataFrame(rows, "z0 double, z1 double, label int, amount double")


def loss(df, name, **kw):
    return build_loss(name, **kw)(df).first()["loss"]


def test_losses_are_finite(spark):
    for n in NAMES:
        assert np.isfinite(loss(frame(spark), n))


def test_unknown_loss(spark):
    with pytest.raises(ValueError, match="Unknown loss"):
        build_loss("nonexistent")


def test_amount_and_positive_weight_raise_the_loss(spark):
    small, large = frame(spark, (0, 1000, 0, 1000)), frame(spark, (0, 1e6, 0, 1e6))
    assert loss(large, "focal_amount") > loss(small, "focal_amount")
    assert loss(small, "focal_amount", amount=None) == pytest.approx(loss(frame(spark, (1, 1, 1, 1)), "focal_amount"), abs=1e-12)
    assert loss(small, "focal_weighted", pos_weight=50.0) > loss(small, "focal_weighted", pos_weight=1.0)
    assert loss(large, "cross_entropy") == loss(small, "cross_entropy")
    total = loss(small, "focal_amount", reduction="sum")
    assert total == pytest.approx(4 * loss(small, "focal_amount"))


def test_pauc_single_class_is_zero(spark):
    assert loss(frame(spark, labels=[1] * 4), "pauc_sigmoid") == 0.0
    assert loss(frame(spark, labels=[0] * 4), "pauc_sigmoid") == 0.0
    assert 0 < loss(frame(spark), "pauc_sigmoid", fpr_max=0.5) < 1
    with pytest.raises(ValueError):
        loss(frame(spark), "pauc_sigmoid", fpr_max=2.0)


@pytest.mark.parametrize("scale", [0.01, 3.0, 60.0, 1e4])
@pytest.mark.parametrize("fpr", [0.0, 0.1, 1.0])
def test_pauc_equals_all_pairs(spark, scale, fpr):
    rng = np.random.default_rng(5)
    z, y = rng.normal(scale=scale, size=400), rng.random(400) < 0.3
    df = spark.createDataFrame([(0.0, float(a), int(b)) for a, b in zip(z, y)], "z0 double, z1 double, label int")
    neg = np.sort(z[~y])[::-1][: max(1, int(fpr * (~y).sum()))]
    d = np.clip(neg[None, :] - z[y][:, None], -700, 700)
    assert loss(df, "pauc_sigmoid", fpr_max=fpr) == pytest.approx((1 / (1 + np.exp(-d))).mean(), abs=1e-13)


def brute(scores, labels):
    s, y = np.array(scores), np.array(labels)
    p, n = s[y == 1], s[y == 0]
    auc = ((p[:, None] > n[None, :]) + 0.5 * (p[:, None] == n[None, :])).mean()
    ap, tp, fp = 0.0, 0, 0
    for t in sorted(set(scores), reverse=True):
        new = (s == t) & (y == 1)
        tp, fp = tp + new.sum(), fp + ((s == t) & (y == 0)).sum()
        ap += new.sum() / len(p) * tp / (tp + fp)
    return auc, ap


@pytest.mark.parametrize("hot_rows", [20, 10**6])
def test_ranking_metrics_with_ties(spark, hot_rows):
    rng = np.random.default_rng(1)
    s = np.round(rng.random(600), 2) * 0.5 + np.where(rng.random(600) < 0.4, 0.0, rng.random(600))
    y = (rng.random(600) < 0.2).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "p1 double, label int")
    r = metrics.ranking_metrics(df, hot_rows=hot_rows).first()
    auc, ap = brute(s.tolist(), y.tolist())
    assert (r["auc"], r["ap"]) == (pytest.approx(auc), pytest.approx(ap))


def test_one_class_metrics(spark):
    df = spark.createDataFrame([(0.2, 0), (0.9, 0)], "p1 double, label int")
    r = metrics.evaluate(df).first()
    assert (r["auc"], r["ap"], r["acc"], r["f1"], r["precision"], r["recall"], r["avg_loss"]) == (0.5, 0.0, 0.5, 0.0, 0.0, 0.0, None)
    assert metrics.threshold_metrics(df).first().asDict() == {"acc": 0.5, "f1": 0.0, "precision": 0.0, "recall": 0.0}


def test_record_agrees_with_its_parts(spark):
    df = spark.createDataFrame([(i % 7 / 7.0, int(i % 3 == 0)) for i in range(50)], "p1 double, label int")
    whole = metrics.evaluate(df).first().asDict()
    parts = metrics.ranking_metrics(df).first().asDict() | metrics.threshold_metrics(df).first().asDict()
    for k in ("auc", "ap", "acc", "f1", "precision", "recall"):
        assert whole[k] == pytest.approx(parts[k])


@pytest.fixture(scope="module")
def pool(spark):
    return spark.createDataFrame([(i, int(i % 11 == 0), i * 2) for i in range(3000)], "row_id long, y int, x int").repartition(5).persist()


@pytest.mark.parametrize("total,ratio,want", [(1000, 0.1, (100, 900)), (5000, 0.5, (273, 2727)), (10, 0.0, (0, 10)), (300, 1.0, (273, 27)), (0, 0.1, (0, 0))])
def test_balanced_counts(pool, total, ratio, want):
    s = sampling.balanced_sample(pool, "y", total=total, ratio=ratio)
    rows = s.collect()
    assert (sum(r["y"] for r in rows), sum(1 - r["y"] for r in rows)) == want
    assert len({r["row_id"] for r in rows}) == len(rows) and s.columns == pool.columns


def test_samples_do_not_depend_on_partitioning(pool):
    pick = lambda d, seed: {r["row_id"] for r in sampling.balanced_sample(d, "y", total=200, seed=seed).collect()}
    assert pick(pool, 1) == pick(pool.repartition(13), 1) != pick(pool, 2)


@pytest.mark.parametrize("n", [1, 7, 500, 3000, 9999])
def test_stratified_sizes(pool, n):
    rows = sampling.stratified_subsample(pool, "y", n).collect()
    assert len(rows) == min(n, 3000)
    assert abs(sum(r["y"] for r in rows) - len(rows) * 273 / 3000) < 1


def test_uniform_subset_and_permutation(pool):
    assert sampling.uniform_subset(pool, 50).count() == 50
    places = sorted(r["place"] for r in sampling.seeded_shuffle(pool).collect())
    assert places == list(range(3000))


def test_pooling(spark):
    df = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("a", 1, [3.0, 6.0]), ("b", 5, [7.0, 8.0])], "k string, i int, v array<float>")
    got = lambda how, eps=0.0: {r["k"]: list(r["pooled"]) for r in vectors.pool(df, ["k"], "v", [F.col("i")], 2, how, eps).collect()}
    assert got("last") == {"a": [3.0, 6.0], "b": [7.0, 8.0]} and got("first")["a"] == [1.0, 2.0] and got("mean")["a"] == [2.0, 4.0]
    head = {r["k"]: r["pooled"] for r in vectors.user_pool(df, ["k"], "v", [F.col("i")], 2, "pool").collect()}
    assert head["b"] == pytest.approx([7.0, 8.0], rel=1e-6) and head["b"] != [7.0, 8.0]
    with pytest.raises(ValueError):
        vectors.pool(df, ["k"], "v", [F.col("i")], 2, "max")


def test_states_are_pooled_under_the_mask():
    h = np.arange(12, dtype=np.float32).reshape(2, 3, 2)
    m = np.array([[1, 1, 0], [0, 0, 0]])
    assert vectors.pool_states(h, m, "last_token").tolist() == [[2, 3], [6, 7]]
    assert vectors.pool_states(h, m, "mean").tolist() == [[1, 2], [0, 0]]
    assert vectors.pool_states(h, m, "first").tolist() == [[0, 1], [6, 7]]


def test_frequency_code(spark):
    df = spark.createDataFrame([(0.0,), (0.5,)], "h double")
    a, b = [r[0] for r in df.select(vectors.frequency_encode(F.col("h"))).collect()]
    assert a == [0.0] * 16 and b[0] == pytest.approx(1.0) and b[8] == pytest.approx(0.0, abs=1e-12) and len(b) == 16


def test_reduced_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 5)) @ np.diag([5, 3, 1, 0.1, 0.01]) + 10
    rows = [(i, "train" if i < 150 else "test", [float(v) for v in r]) for i, r in enumerate(x)]
    out, _, ratio = ml.pca_reduce(spark.createDataFrame(rows, "row_id long, split string, embedding array<double>"), k=2)
    z = np.array([r["pca"] for r in out.orderBy("row_id").collect()])
    train = x[:150] - x[:150].mean(axis=0)
    w, v = np.linalg.eigh(np.cov(train.T))
    want = (x - x[:150].mean(axis=0)) @ v[:, ::-1][:, :2]
    assert np.allclose(np.abs(z), np.abs(want), atol=1e-8) and ratio == pytest.approx(w[::-1][:2].sum() / w.sum())


def test_unseen_and_missing_codes(spark):
    df = spark.createDataFrame(
        [("train", "b", 1), ("train", "a", 2), ("val", "c", 3), ("val", None, 4), ("test", "b", 5)], "split string, s string, n int"
    )
    out, order = ml.ordinal_encode(df, ["n", "s"])
    assert order == ["s", "n"]
    assert {r["n"]: r["s"] for r in out.collect()} == {1: 1.0, 2: 0.0, 3: -1.0, 4: None, 5: 1.0}


def test_model_table(spark):
    rows = [(0, "a", 3, 0.8, 0.4), (1, "b", 4, 0.9, 0.5), (2, "c", 7, 0.9, 0.3)]
    r = metrics.model_comparison(spark.createDataFrame(rows, "pos int, model string, feature_dim int, test_auc double, test_ap double"))
    got = {x["pos"]: x for x in r.collect()}
    assert [got[i]["best_auc"] for i in range(3)] == [False, True, False] and got[1]["best_ap"]
    assert got[1]["auc_lift_pct"] == pytest.approx(12.5) and got[2]["ap_lift_pct"] == pytest.approx(-25.0) and got[0]["metrics_agree"]


@pytest.mark.parametrize("slice_rows", [sampling.SLICE_ROWS, 1])
@pytest.mark.parametrize("literal", [sampling.LITERAL_CLASSES, 0])
def test_samples_neither_join_nor_shuffle_the_rows(spark, monkeypatch, slice_rows, literal):
    monkeypatch.setattr(sampling, "LITERAL_CLASSES", literal)
    df = spark.range(3000).select(F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("y"), F.lit("x").alias("wide"))
    quotas = lambda counts: counts.select("stratum", (F.lit(100) + F.coalesce("stratum", F.lit(0))).cast("bigint").alias("quota"))
    got = sampling.take_exact(df, quotas, F.col("y"), ["row_id"], slice_rows=slice_rows)
    key = sampling.shuffle_key(42, "row_id")
    want = [r["row_id"] for y, n in ((0, 100), (1, 101)) for r in df.where(F.col("y") == y).orderBy(key).limit(n).collect()]
    assert sorted(r["row_id"] for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan and "CartesianProduct" not in plan
    if literal:
        assert "Join" not in plan
        uniform = sampling.uniform_subset(df, 50)
        plan = uniform._jdf.queryExecution().executedPlan().toString()
        assert uniform.count() == 50 and "Join" not in plan and "Exchange" not in plan.replace("ShuffleQueryStage", "")
