"""Ranking metrics, threshold metrics and losses on prediction tables.

Predictions are first counted per distinct score, which also folds any number of tied
rows into one. Running counts over the scores come from ``ordered_scan``, so nothing
is ranked in a single task once the scores outgrow one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .ordered import HOT_ROWS, ordered_scan


def score_counts(preds: DataFrame, score: str = "p1", label: str = "label") -> DataFrame:
    """(score, pos, neg) per distinct score."""
    y = F.col(label)
    return preds.groupBy(F.col(score).alias("score")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")
    )


def cumulative_tp_fp(preds: DataFrame, score: str = "p1", label: str = "label", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per distinct score in descending order: rows, and running true and false positives."""
    # Stored, so that the predictions are read once however often the counts are.
    c = materialize(score_counts(preds, score, label), "scores")
    return ordered_scan(c, [], [-F.col("score")], sums={"tp": "pos", "fp": "neg"}, hot_rows=hot_rows)


def ranking_metrics(preds: DataFrame, score: str = "p1", label: str = "label", hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row: ROC-AUC with ties at half weight and step-wise average precision.
    With a single class the AUC is 0.5; without positives the precision is 0."""
    c = cumulative_tp_fp(preds, score, label, hot_rows)
    pos, neg, tp, fp = (F.col(x).cast("double") for x in ("pos", "neg", "tp", "fp"))
    agg = c.agg(
        F.sum(neg * (tp - pos / 2)).alias("_wins"),
        F.sum(pos * tp / (tp + fp)).alias("_prec"),
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
    )
    p, n = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    return agg.select(
        F.coalesce(F.try_divide(F.col("_wins"), p * n), F.lit(0.5)).alias("auc"),
        F.coalesce(F.try_divide(F.col("_prec"), p), F.lit(0.0)).alias("ap"),
        F.coalesce("n_pos", F.lit(0)).cast("bigint").alias("n_pos"),
        F.coalesce("n_neg", F.lit(0)).cast("bigint").alias("n_neg"),
    )


def threshold_metrics(preds: DataFrame, score: str = "p1", label: str = "label", at: float = 0.5) -> DataFrame:
    """Accuracy, F1, precision and recall for ``score >= at``; a zero divisor gives 0."""
    hit, y = F.col(score) >= F.lit(at), F.col(label) == 1
    c = preds.agg(
        F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"),
        F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return c.select(
        ratio(tp + tn, tp + fp + fn + tn).alias("acc"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
    )


def softmax_p1(z0: Column, z1: Column) -> Column:
    d = z0 - z1
    return F.when(d > 0, F.exp(-d) / (1.0 + F.exp(-d))).otherwise(1.0 / (1.0 + F.exp(d)))


def predictions(logits: DataFrame, keep: list[str], z0: str = "z0", z1: str = "z1") -> DataFrame:
    """(p0, p1, pred, pred_prob) of two-class logits."""
    p1 = softmax_p1(F.col(z0), F.col(z1))
    out = logits.select(*keep, (1.0 - p1).alias("p0"), p1.alias("p1"))
    return out.withColumns({"pred": (F.col("p1") >= 0.5).cast("int"), "pred_prob": F.col("p1")})


# -- losses ---------------------------------------------------------------------


def row_cross_entropy(z0: Column, z1: Column, y: Column) -> Column:
    """Softmax cross entropy of a row, stable for large logits."""
    top = F.greatest(z0, z1)
    lse = top + F.log1p(F.exp(F.least(z0, z1) - top))
    return lse - F.when(y == 1, z1).otherwise(z0)


def row_focal(ce: Column, alpha: float, gamma: float) -> Column:
    return F.lit(alpha) * F.pow(1.0 - F.exp(-ce), F.lit(gamma)) * ce


def _reduce(loss: Column, reduction: str) -> Column:
    if reduction == "mean":
        return F.avg(loss)
    if reduction == "sum":
        return F.sum(loss)
    if reduction == "none":
        return loss
    raise ValueError(f"unknown reduction {reduction!r}")


def cross_entropy(z0="z0", z1="z1", label="label", reduction="mean", **_) -> Column:
    return _reduce(row_cross_entropy(F.col(z0), F.col(z1), F.col(label)), reduction)


def focal_weighted(
    z0="z0", z1="z1", label="label", alpha=0.25, gamma=2.0, pos_weight=10.0, reduction="mean", **_
) -> Column:
    """Focal loss with the positive class weighted inside the cross entropy."""
    ce = row_cross_entropy(F.col(z0), F.col(z1), F.col(label))
    ce = ce * F.when(F.col(label) == 1, F.lit(float(pos_weight))).otherwise(F.lit(1.0))
    return _reduce(row_focal(ce, alpha, gamma), reduction)


def amount_weight(amount: Column, amount_clip: float = 4.0) -> Column:
    return F.greatest(F.least(0.5 * (amount / 100000.0), F.lit(float(amount_clip))), F.lit(1.0))


def focal_amount(
    z0="z0", z1="z1", label="label", amount: str | None = "amount", alpha=0.25, gamma=2.0,
    amount_clip=4.0, pos_only=True, reduction="mean", **_
) -> Column:
    """Focal loss weighted by amount, for positives only unless told otherwise."""
    loss = row_focal(row_cross_entropy(F.col(z0), F.col(z1), F.col(label)), alpha, gamma)
    a = F.lit(1.0) if amount is None else F.col(amount).cast("double")
    w = amount_weight(a, amount_clip)
    if pos_only:
        w = F.when(F.col(label) == 1, w).otherwise(F.lit(1.0))
    return _reduce(w * loss, reduction)


LOSSES = {"cross_entropy": cross_entropy, "focal_weighted": focal_weighted, "focal_amount": focal_amount}


def build_loss(name: str, **params):
    """Loss by name as a function ``DataFrame -> one-row DataFrame (loss)``."""
    if name == "pauc_sigmoid":
        from .pairwise import pauc_sigmoid

        return lambda df: pauc_sigmoid(df, **params)
    if name not in LOSSES:
        raise ValueError(f"Unknown loss {name!r}; known: {sorted([*LOSSES, 'pauc_sigmoid'])}")
    return lambda df: df.agg(LOSSES[name](**params).alias("loss"))


# -- model comparison --------------------------------------------------------------


def model_comparison(results: DataFrame) -> DataFrame:
    """Best-model flags and lift over the first model; ``results(pos, model, feature_dim,
    test_auc, test_ap)`` has a row per model."""
    every = Window.partitionBy()
    first = Window.partitionBy().orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = lambda c: F.col("pos") == F.min(F.when(F.col(c) == F.col(f"_max_{c}"), F.col("pos"))).over(every)
    lift = lambda c: (F.col(c) - F.first(c).over(first)) / F.first(c).over(first) * 100
    r = results.withColumns({f"_max_{c}": F.max(c).over(every) for c in ("test_auc", "test_ap")})
    r = r.withColumns(
        {
            "best_auc": best("test_auc"), "best_ap": best("test_ap"),
            "auc_lift_pct": lift("test_auc"), "ap_lift_pct": lift("test_ap"),
        }
    )
    agree = F.max((F.col("best_auc") & F.col("best_ap")).cast("int")).over(every) == 1
    return r.withColumn("metrics_agree", agree).drop("_max_test_auc", "_max_test_ap")


def evaluate(
    preds: DataFrame, loss: Column | None = None, score: str = "p1", label: str = "label", at: float = 0.5
) -> DataFrame:
    """The full metric record in one row: ranking and threshold metrics, sample count, and
    the plain mean of a per-row loss. Everything is folded from the per-score counts."""
    y = F.col(label)
    c = preds.groupBy(F.col(score).alias("score")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"),
        F.sum(F.lit(None).cast("double") if loss is None else loss).alias("loss"),
    )
    c = ordered_scan(materialize(c, "scores"), [], [-F.col("score")], sums={"_tp": "pos", "_fp": "neg"})
    pos, neg, tp, fp = (F.col(x).cast("double") for x in ("pos", "neg", "_tp", "_fp"))
    hit = F.col("score") >= at
    agg = c.agg(
        F.sum(neg * (tp - pos / 2)).alias("wins"), F.sum(pos * tp / (tp + fp)).alias("prec"),
        F.sum(pos).alias("P"), F.sum(neg).alias("N"),
        F.sum(F.when(hit, pos).otherwise(0.0)).alias("tp"), F.sum(F.when(hit, neg).otherwise(0.0)).alias("fp"),
        F.sum("loss").alias("loss"),
    )
    P, N, TP, FP = (F.col(x) for x in ("P", "N", "tp", "fp"))
    ratio = lambda a, b, z=0.0: F.coalesce(F.try_divide(a, b), F.lit(z))
    return agg.select(
        ratio(F.col("wins"), P * N, 0.5).alias("auc"), ratio(F.col("prec"), P).alias("ap"),
        ratio(TP + N - FP, P + N).alias("acc"), ratio(2 * TP, TP + FP + P).alias("f1"),
        ratio(TP, TP + FP).alias("precision"), ratio(TP, P).alias("recall"),
        F.coalesce(P + N, F.lit(0.0)).cast("bigint").alias("n_samples"),
        F.try_divide(F.col("loss"), P + N).alias("avg_loss"),
    )
