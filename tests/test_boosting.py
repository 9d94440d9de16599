"""Histogram trees against a search over all splits, one row at a time."""

import math
import random

import pytest

from ledgerspark.operators import boosting as b
from ledgerspark.operators.metrics import ranking_metrics

FEATURES = ["x", "a b", "z"]
CUTS = [[1.0, 2.0, 3.0], [0.5], [-1.0, 0.0, 4.0]]


def binned(row):
    return [-1 if v is None or math.isnan(v) else sum(c <= v for c in cuts) for v, cuts in zip(row, CUTS)]


def drawn(g, l1):
    return math.copysign(max(abs(g) - l1, 0.0), g)


def plain_tree(rows, s, features, node=0, depth=0):
    """rows: (bins, g, h). {node: value or split}"""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    out = {node: -s.step * drawn(g, s.l1) / (h + s.l2)}
    if depth == s.depth:
        return out
    score = lambda g, h: drawn(g, s.l1) ** 2 / (h + s.l2)
    best = None
    for f in features:
        for cut in range(-1, len(CUTS[f]) + 1):
            for missing_left in (True, False):
                left = [r for r in rows if (r[0][f] <= cut if missing_left else 0 <= r[0][f] <= cut)]
                gl, hl = sum(r[1] for r in left), sum(r[2] for r in left)
                if hl < s.min_hessian or h - hl < s.min_hessian or not left or len(left) == len(rows):
                    continue
                gain = 0.5 * (score(gl, hl) + score(g - gl, h - hl) - score(g, h)) - s.min_gain
                rank = (round(gain, 9), -f, -cut, missing_left)
                if round(gain, 12) > 0 and (best is None or rank > best[0]):
                    best = (rank, (f, cut, missing_left), left)
    if best:
        kept = {id(r) for r in best[2]}
        out = {("split", node): best[1]}
        out |= plain_tree(best[2], s, features, 2 * node + 1, depth + 1)
        out |= plain_tree([r for r in rows if id(r) not in kept], s, features, 2 * node + 2, depth + 1)
    return out


def table(spark, n, seed):
    r = random.Random(seed)
    pick = lambda *v: r.choice(v)
    rows = []
    for k in range(n):
        x, a, z = pick(0.0, 1.0, 2.5, 3.0, None, float("nan")), pick(0.0, 1.0, None), pick(-2.0, -0.5, 1.0, 9.0)
        p = 0.15 + 0.5 * (x in (2.5, 3.0)) + 0.2 * (a is None)
        rows.append((k, x, a, z, None if k % 41 == 0 else int(r.random() < p), pick("train", "train", "val", "test"), "_bins"))
    return rows, spark.createDataFrame(rows, "row_id long, x double, `a b` double, z double, label int, split string, _margin string").drop("_margin").repartition(3)


def plain_fit(rows, s):
    live = [r for r in rows if r[4] is not None]
    train, margins, trees = [r for r in live if r[5] == "train"], {r[0]: 0.0 for r in live}, []
    for _ in range(s.rounds):
        sig = lambda m: 1 / (1 + math.exp(-m))
        tree = plain_tree([(binned(r[1:4]), (s.positive_weight if r[4] else 1) * (sig(margins[r[0]]) - r[4]),
                            (s.positive_weight if r[4] else 1) * sig(margins[r[0]]) * (1 - sig(margins[r[0]]))) for r in train], s, range(3))
        trees.append(tree)
        for r in live:
            node, bins = 0, binned(r[1:4])
            while ("split", node) in tree:
                f, cut, missing_left = tree["split", node]
                node = 2 * node + (1 if (bins[f] <= cut if missing_left else 0 <= bins[f] <= cut) else 2)
            margins[r[0]] += tree[node]
        yield trees, margins


def auc(rows, margins, split="val"):
    pos = [margins[r[0]] for r in rows if r[4] == 1 and r[5] == split]
    neg = [margins[r[0]] for r in rows if r[4] == 0 and r[5] == split]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("s, nested", [
    (b.Settings(rounds=2, depth=3, step=0.3, l1=0.4, l2=0.7, min_hessian=0.5), b.NESTED_SPLITS), (b.Settings(rounds=2, depth=3, l2=0.0, min_gain=0.1, positive_weight=3.0), 0),
])
def test_trees_equal_a_search_over_all_splits(spark, monkeypatch, s, nested):
    monkeypatch.setattr(b, "NESTED_SPLITS", nested)
    rows, df = table(spark, 300, 5)
    model = b.fit(df, FEATURES, settings=s, cuts=CUTS)
    *_, (trees, margins) = plain_fit(rows, s)
    for got, want in zip(model.trees, trees):
        assert got.splits == {k[1]: v for k, v in want.items() if isinstance(k, tuple)}
        leaves = {k: v for k, v in want.items() if not isinstance(k, tuple)}
        assert {k: pytest.approx(v, abs=1e-9) for k, v in leaves.items()} == got.values
    p = {r["row_id"]: r["p1"] for r in model.predict(df).collect()}
    assert all(p[k] == pytest.approx(1 / (1 + math.exp(-m)), abs=1e-9) for k, m in margins.items())


def test_patience_stops_where_a_plain_loop_does(spark):
    s = b.Settings(rounds=14, depth=2, step=0.8, min_hessian=0.1, l2=0.1, patience=3)
    rows, df = table(spark, 160, 8)
    best, best_at, history = -1.0, 0, []
    for k, (_, margins) in enumerate(plain_fit(rows, s), 1):
        history.append(auc(rows, margins))
        if history[-1] > best + 1e-12:
            best, best_at = history[-1], k
        elif k - best_at >= s.patience:
            break
    model = b.fit(df, FEATURES, settings=s, cuts=CUTS)
    assert model.best_round == best_at and model.history == pytest.approx(history)
    scored = model.predict(df.where("split = 'val' AND label IS NOT NULL"))
    assert ranking_metrics(scored, "p1", "label").first()["auc"] == pytest.approx(best)


def test_shares_and_edges(spark):
    rows, df = table(spark, 200, 9)
    s = b.Settings(rounds=2, depth=2, row_share=0.5, column_share=0.34, bins=4)
    one, two = b.fit(df, FEATURES, settings=s), b.fit(df.repartition(5), FEATURES, settings=s)
    assert [t.splits for t in one.trees] == [t.splits for t in two.trees]
    assert all(len({x[0] for x in t.splits.values()}) <= 1 for t in one.trees)
    none = b.fit(df.where("label = 0"), FEATURES, settings=s)
    assert none.trees == [] and {r["p1"] < 1e-6 for r in none.predict(df).collect()} == {True}
    assert b.fit(df.limit(0), FEATURES, settings=s).trees == []
    wide, names = b.vector_columns(spark.createDataFrame([([1.0, 2.0],)], "v array<float>"), "v", 3)
    assert names == ["v_0", "v_1", "v_2"] and wide.first()["v_2"] is None
