"""Losses over all (positive, hard negative) pairs, without forming the pairs.

The number of pairs is the product of two counts that both grow with the data. What is
wanted is a sum over pairs, and that sum separates: scores are grouped into cells of
width 1/4, and inside a pair of cells ``sigmoid(n - p)`` is its Taylor series around the
centre difference. The radius of convergence is pi and the argument moves by at most
1/4, so 14 terms leave less than 1e-15: the result is exact to double precision. What is
kept per cell are 14 power sums, so the work is one aggregate plus (cells x neighbours).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .metrics import score_counts
from .ordered import HOT_ROWS, ordered_scan

WIDTH = 0.25
TERMS = 14
REACH = 160  # cells; 40 units of score, where a sigmoid is 0 or 1 to double precision


def hard_negative_count(n_neg: int, fpr_max: float) -> int:
    return max(1, int(fpr_max * n_neg))


def stored_scores(preds: DataFrame, score: str, label: str) -> DataFrame:
    """Counts per distinct score, written once: the predictions are read a single time."""
    return materialize(score_counts(preds, score, label), "scores")


def _top(counts: DataFrame, k: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    c = counts.where(F.col("neg") > 0)
    c = ordered_scan(c, [], [-F.col("score")], sums={"_cum": "neg"}, hot_rows=hot_rows)
    before = F.col("_cum") - F.col("neg")
    return c.where(before < k).select("score", F.least(F.col("neg"), F.lit(k) - before).alias("n"))


def topk_negatives(preds: DataFrame, k: int, score: str = "z1", label: str = "label", hot_rows: int = HOT_ROWS) -> DataFrame:
    """The ``k`` highest negative scores as (score, n): running counts over the distinct
    scores say how many rows of each are taken, so ``k`` may be any share of the data."""
    return _top(stored_scores(preds, score, label), k, hot_rows)


def _class_sizes(counts: DataFrame) -> tuple[int, int]:
    r = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    return r["p"] or 0, r["n"] or 0


def _positives(counts: DataFrame) -> DataFrame:
    return counts.where("pos > 0").select("score", F.col("pos").alias("n"))


def pair_summary(preds: DataFrame, fpr_max: float = 0.1, score: str = "z1", label: str = "label") -> DataFrame:
    """Counts, mean and range of the margin (positive minus negative score) over all pairs
    of a positive with one of the hardest negatives."""
    counts = stored_scores(preds, score, label)
    _, n = _class_sizes(counts)
    k = hard_negative_count(n, fpr_max) if n else 0
    both = _positives(counts).withColumn("y", F.lit(1)).unionByName(_top(counts, k).withColumn("y", F.lit(0)))
    s, w = F.col("score"), F.col("n")
    part = lambda y, e: F.when(F.col("y") == y, e)
    agg = both.agg(
        F.sum(part(1, w)).alias("n_pos"), F.sum(part(0, w)).alias("k"),
        (F.sum(part(1, s * w)) / F.sum(part(1, w)) - F.sum(part(0, s * w)) / F.sum(part(0, w))).alias("mean_margin"),
        (F.min(part(1, s)) - F.max(part(0, s))).alias("min_margin"),
        (F.max(part(1, s)) - F.min(part(0, s))).alias("max_margin"),
    )
    return agg.select("n_pos", "k", (F.col("n_pos") * F.col("k")).alias("n_pairs"), "mean_margin", "min_margin", "max_margin")


def sigmoid_derivative_polynomials(terms: int = TERMS) -> list[list[float]]:
    """Derivatives of the sigmoid as polynomials in its value, divided by the factorial."""
    poly, out = [0.0, 1.0], []
    for m in range(terms):
        out.append([c / math.factorial(m) for c in poly])
        d = [i * c for i, c in enumerate(poly)][1:]
        nxt = [0.0] * (len(d) + 2)
        for i, c in enumerate(d):  # times s * (1 - s)
            nxt[i + 1] += c
            nxt[i + 2] -= c
        poly = nxt
    return out


def _cells(scores: DataFrame, prefix: str) -> DataFrame:
    cell = F.floor(F.col("score") / WIDTH).cast("bigint")
    d = F.col("score") - (cell + 0.5) * WIDTH
    return scores.groupBy(cell.alias(f"{prefix}_cell")).agg(
        *[F.sum(F.col("n") * F.pow(d, F.lit(k))).alias(f"{prefix}{k}") for k in range(TERMS)]
    )


def _series() -> str:
    """The Taylor sum of one pair of cells as SQL text over ``_s``, ``p<k>`` and ``q<k>``."""
    terms = []
    for m, coefs in enumerate(sigmoid_derivative_polynomials()):
        value = repr(coefs[-1]) + "D"
        for c in reversed(coefs[:-1]):
            value = f"({value} * _s + {c!r}D)"
        moment = " + ".join(f"{float(math.comb(m, j) * (-1) ** (m - j))!r}D * q{j} * p{m - j}" for j in range(m + 1))
        terms.append(f"{value} * ({moment})")
    return " + ".join(terms)


def pauc_sigmoid(preds: DataFrame, fpr_max: float = 0.1, score: str = "z1", label: str = "label") -> DataFrame:
    """One row ``loss``: mean of ``sigmoid(negative - positive)`` over all positives and the
    hardest ``fpr_max`` share of negatives; 0 when one class is missing."""
    if not 0 <= fpr_max <= 1:
        raise ValueError(f"fpr_max got {fpr_max}")
    counts = stored_scores(preds, score, label)
    n_pos, n_neg = _class_sizes(counts)
    if not n_pos or not n_neg:
        return counts.agg(F.lit(0.0).alias("loss"))
    k = hard_negative_count(n_neg, fpr_max)
    pos, neg = _cells(_positives(counts), "p"), _cells(_top(counts, k), "q")

    near = pos.withColumn("q_cell", F.explode(F.sequence(F.col("p_cell") - REACH, F.col("p_cell") + REACH)))
    near = near.join(neg, "q_cell")
    s = 1.0 / (1.0 + F.exp((F.col("p_cell") - F.col("q_cell")).cast("double") * WIDTH))
    near_sum = near.withColumn("_s", s).select(F.expr(_series()).alias("v"))

    # Negatives more than REACH cells above a positive count 1, those below count 0.
    marks = neg.select(F.col("q_cell").alias("at"), F.lit(0).alias("kind"), F.col("q0").alias("q"), F.lit(0.0).alias("p")).unionByName(
        pos.select((F.col("p_cell") + REACH).alias("at"), F.lit(1).alias("kind"), F.lit(0.0).alias("q"), F.col("p0").alias("p"))
    )
    run = ordered_scan(marks, [], [-F.col("at"), F.col("kind").cast("bigint") * -1], sums={"above": "q"})
    far_sum = run.where("kind = 1").select((F.col("p") * F.col("above")).alias("v"))
    return near_sum.unionByName(far_sum).agg((F.sum("v") / F.lit(float(n_pos) * k)).alias("loss"))
