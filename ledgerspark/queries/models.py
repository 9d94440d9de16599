"""Encoders, reduction and classifiers. Trees and component signs have no SQL form; for
those the queries return what does not depend on the solver where there is such a thing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import boosting, ml
from ..operators.align import align
from ..operators.metrics import ranking_metrics
from ..operators.split import temporal_split_date
from ..plans import card, jobs  # noqa: F401
from ..session import materialize
from . import views
from .registry import query
from .sql import with_

SMALL = {
    "raw": dict(rounds=5, depth=3, step=0.1),
    "embed": dict(rounds=5, depth=3, step=0.1),
    "combined": dict(rounds=5, depth=3, step=0.1),
}


@query(with_("v_split", """
, a AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT "Use Chip" AS v FROM v_split WHERE split = 'train')),
b AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT "Time" AS v FROM v_split WHERE split = 'train' AND "Time" IS NOT NULL))
SELECT row_id, split, a.i::DOUBLE AS chip_code, CASE WHEN "Time" IS NULL THEN NULL ELSE coalesce(b.i, -1)::DOUBLE END AS time_code, 'Use Chip,Time,MCC' AS feature_order
FROM v_split LEFT JOIN a ON "Use Chip" = a.v LEFT JOIN b ON "Time" = b.v
"""))
def ordinal_encode(spark, sf):
    s, _ = temporal_split_date(views.card(spark, sf))
    out, order = ml.ordinal_encode(s, ["MCC", "Use Chip", "Time"])
    return out.select(
        "row_id", "split", F.col("Use Chip").alias("chip_code"), F.col("Time").alias("time_code"), F.lit(",".join(order)).alias("feature_order")
    )


@query(with_("v_emb", "SELECT split, count(*) AS n_rows, 16::INT AS dim, 1::INT AS centred, 1::INT AS falling, 1::INT AS share_below_one, 1::INT AS orthonormal FROM v_emb GROUP BY split"))
def pca_reduce(spark, sf):
    """Facts of the reduction that hold for any solver, as 0/1: training means are 0, variances
    fall from component to component, together they explain at most all of the variance, and the
    components have length 1 and are square to each other."""
    k = 16
    out, model, ratio = ml.pca_reduce(views.vectors(spark, sf), k=k)
    stats = out.where("split = 'train'").agg(
        *[F.avg(F.get("pca", i)).alias(f"m{i}") for i in range(k)], *[F.variance(F.get("pca", i)).alias(f"v{i}") for i in range(k)]
    ).first()
    centred = all(abs(stats[f"m{i}"]) < 1e-6 for i in range(k))
    pc = model.pc.toArray()
    orthonormal = bool(np.abs(pc.T @ pc - np.eye(k)).max() < 1e-9)
    falling = all(stats[f"v{i}"] >= stats[f"v{i + 1}"] - 1e-9 for i in range(k - 1))
    return out.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.size("pca")).alias("dim"), F.lit(int(centred)).alias("centred"),
        F.lit(int(falling)).alias("falling"), F.lit(int(0 < ratio <= 1 + 1e-9)).alias("share_below_one"),
        F.lit(int(orthonormal)).alias("orthonormal"),
    )


def _aligned(spark, sf):
    raw = card.engineer_features(views.card(spark, sf)).select("row_id", "Hour", "Amount", "Card", F.col("`Use Chip`"), "MCC")
    # A label that the vectors can tell, so that models have something to find.
    v = views.vectors(spark, sf).withColumn("label", (F.get("embedding", 0) > 0).cast("int"))
    return align(raw, v, ["row_id"])


@query(with_("v_emb v_card", """
SELECT e.split, count(*) AS n_rows, 1::INT AS in_range, 1::INT AS better_than_chance FROM v_emb e JOIN v_card USING (row_id) WHERE e.split <> 'train' GROUP BY e.split
"""))
def train_classifier(spark, sf):
    """Rows scored per split; all probabilities lie in 0..1 and the test AUC is at least 0.8."""
    data = ml.assemble(_aligned(spark, sf), ["Hour", "Amount", "Card", "MCC"], "embedding", 64)
    _, scored = ml.train_classifier(data, **SMALL["raw"])
    scored = materialize(scored.select("split", "label", "p1"), "scored")
    auc = ranking_metrics(scored.where("split = 'test'"), "p1", "label").first()["auc"]
    return scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(F.col("p1").between(0, 1).cast("int")).alias("in_range"), F.lit(int(auc >= 0.8)).alias("better_than_chance")
    )


@query("""
SELECT * FROM (VALUES ('Raw features', 5::INT), ('8d PCA embeddings', 8::INT), ('Combined (5+8d)', 13::INT)) AS t(model, feature_dim),
  (SELECT 1::INT AS in_range, 1::INT AS lift_adds_up, 1::INT AS vectors_help FROM orders LIMIT 1)
""")
def three_model_comparison(spark, sf):
    """The models and their widths; every metric lies in 0..1, and the lift is the gain over
    the raw model; a model that sees the vectors tells a label that lies in them better than the
    raw one, which is a chance model there."""
    out = materialize(ml.three_model_comparison(_aligned(spark, sf), ["Hour", "Amount", "Card", "Use Chip", "MCC"], k=8, settings=SMALL), "models")
    metrics = [c for c in out.columns if c in ("val_auc", "val_ap", "test_auc", "test_ap")]
    fine = F.lit(True)
    for c in metrics:
        fine = fine & F.col(c).between(0, 1)
    raw = out.where("model = 'Raw features'").first()["test_auc"]
    adds = F.abs(F.col("auc_lift_pct") - (F.col("test_auc") - F.lit(raw)) / F.lit(raw) * 100) < 1e-6
    helps = (F.col("model") == "Raw features") | (F.col("test_auc") > F.lit(raw))
    return out.select("model", "feature_dim", fine.cast("int").alias("in_range"), adds.cast("int").alias("lift_adds_up"), helps.cast("int").alias("vectors_help"))


BOOST_FEATURES = ["Hour", "MCC", "Card", "Month"]
BOOST_L1, BOOST_L2, BOOST_STEP = 0.5, 1.0, 0.3


@query(with_("v_target", f"""
, r AS (SELECT 0.5::DOUBLE - y AS g, 0.25::DOUBLE AS h, split_part("Time", ':', 1)::INT AS x0, "MCC" AS x1, "Card" AS x2, "Month" AS x3 FROM v_target WHERE split = 'train'),
e AS (
  SELECT 0 AS f, x0 AS x, g, h FROM r UNION ALL SELECT 1, x1, g, h FROM r UNION ALL SELECT 2, x2, g, h FROM r UNION ALL SELECT 3, x3, g, h FROM r),
t AS (SELECT f, sum(g) AS gt, sum(h) AS ht, coalesce(sum(g) FILTER (x IS NULL), 0) AS gm, coalesce(sum(h) FILTER (x IS NULL), 0) AS hm FROM e GROUP BY f),
b AS (SELECT f, x AS cut, sum(sum(g)) OVER w AS gk, sum(sum(h)) OVER w AS hk FROM e WHERE x IS NOT NULL GROUP BY f, x WINDOW w AS (PARTITION BY f ORDER BY x)),
c AS (
  SELECT f, cut, m AS missing_left, gt, ht, gk + m * gm AS gl, hk + m * hm AS hl FROM b JOIN t USING (f), (VALUES (0), (1)) AS s(m)
  UNION ALL SELECT f, NULL, 1, gt, ht, gm, hm FROM t),
d AS (
  SELECT *, greatest(abs(gl) - {BOOST_L1}, 0) ** 2 / (hl + {BOOST_L2}) + greatest(abs(gt - gl) - {BOOST_L1}, 0) ** 2 / (ht - hl + {BOOST_L2})
    - greatest(abs(gt) - {BOOST_L1}, 0) ** 2 / (ht + {BOOST_L2}) AS twice
  FROM c WHERE hl >= 1 AND ht - hl >= 1),
k AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY round(twice / 2, 9) DESC, cut NULLS FIRST, missing_left DESC) AS n FROM d WHERE round(twice / 2, 12) > 0)
SELECT ['Hour', 'MCC', 'Card', 'Month'][f + 1] AS feature, cut::DOUBLE AS cut, missing_left = 1 AS missing_left, round((twice / 2)::DOUBLE, 6) AS gain,
  round((-{BOOST_STEP} * sign(gl) * greatest(abs(gl) - {BOOST_L1}, 0) / (hl + {BOOST_L2}))::DOUBLE, 6) AS left_value,
  round((-{BOOST_STEP} * sign(gt - gl) * greatest(abs(gt - gl) - {BOOST_L1}, 0) / (ht - hl + {BOOST_L2}))::DOUBLE, 6) AS right_value
FROM k WHERE n = 1
"""))
def boosted_splits(spark, sf):
    """The first split that every single feature offers: the tree's histograms and gains at the root. A null
    cut parts missing values from the others."""
    s, _ = temporal_split_date(views.card(spark, sf))
    rows = s.where("split = 'train'").select(
        F.split_part("Time", F.lit(":"), F.lit(1)).cast("int").alias("Hour"), "MCC", "Card", "Month", F.col("`Is Fraud?`").isin("Yes", "1").cast("int").alias("y")
    )
    values = rows.select(*[F.sort_array(F.collect_set(c)).alias(c) for c in BOOST_FEATURES]).first()  # a few codes each
    cuts = [[float(x) for x in values[c]][1:] for c in BOOST_FEATURES]
    settings = boosting.Settings(l1=BOOST_L1, l2=BOOST_L2, step=BOOST_STEP)
    data = rows.select(F.lit(0).alias("_node"), boosting.bin_array(BOOST_FEATURES, cuts).alias("_bins"), (0.5 - F.col("y")).alias("_g"), F.lit(0.25).alias("_h"))
    sums = boosting.histograms(data, list(range(len(BOOST_FEATURES))), [0]).withColumn("node", F.col("f"))
    best = boosting.best_splits(sums, settings).where("gain IS NOT NULL")
    value = lambda g, h: F.round(-settings.step * F.signum(g) * F.greatest(F.abs(g) - settings.l1, F.lit(0.0)) / (h + settings.l2), 6)
    shown = F.array(*[F.array(*[F.lit(float(x)) for x in values[c]]) for c in BOOST_FEATURES])
    return best.select(
        F.get(F.lit(BOOST_FEATURES), F.col("node")).alias("feature"), F.when(F.col("cut") >= 0, F.get(F.get(shown, F.col("node")), F.col("cut"))).alias("cut"), "missing_left",
        F.round("gain", 6).alias("gain"), value(F.col("gl"), F.col("hl")).alias("left_value"), value(F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")).alias("right_value"),
    )
