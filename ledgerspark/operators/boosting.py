"""Boosted trees by second-order histograms, grown level by level.

Features are cut at quantiles from a sketch, once. A tree is grown one level at a time: every row
knows its node, one grouped aggregate sums gradients and Hessians per node, feature and bin, and
a window over the bins, which are few, finds each node's best split. Rows with a missing value go to
the side where the loss falls more. What the driver sees of a level is one row per node.

Every row carries its bins as one array, so a level is a scan, a partial aggregate of at most nodes x
features x bins rows per task, and no shuffle of the data. The table with bins and margins is
written again every ``SAVE_ROUNDS`` rounds; in between a row's margin is computed from the few
trees since then.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .metrics import ranking_metrics

SAVE_ROUNDS = 8
NESTED_SPLITS = 31    # splits up to which a tree is one expression of nested conditions
SKETCH_ERROR = 1e-3   # rank error of the cut points, relative to the rows
_SALT = 1 << 20       # slots of the seeded row shares


@dataclass(frozen=True)
class Settings:
    rounds: int = 100
    depth: int = 6
    step: float = 0.1
    row_share: float = 1.0       # rows of a tree, by a seeded hash of their key
    column_share: float = 1.0    # features of a tree
    min_hessian: float = 1.0     # of either side of a split
    l1: float = 0.0
    l2: float = 1.0
    min_gain: float = 0.0
    positive_weight: float = 1.0
    bins: int = 64
    patience: int | None = None  # rounds without a better AUC of the 'val' rows
    seed: int = 42


@dataclass
class Tree:
    """Node i has the children 2i+1 and 2i+2. ``splits[i]`` is (feature, last bin of the left side,
    whether missing values go left); ``values[i]`` what a leaf adds to the margin."""

    splits: dict[int, tuple[int, int, bool]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def node(self, bins: Column, depth: int | None = None) -> Column:
        """The node of a row, of the last level or of level ``depth``: nested conditions for a small
        tree, steps through arrays for a large one."""
        if len(self.splits) > NESTED_SPLITS:
            return self._walked(bins, depth)

        def go(i: int, level: int) -> Column:
            if i not in self.splits or level == depth:
                return F.lit(i)
            f, cut, missing_left = self.splits[i]
            b = F.get(bins, f)
            left = b <= cut if missing_left else (b <= cut) & (b >= 0)
            return F.when(left, go(2 * i + 1, level + 1)).otherwise(go(2 * i + 2, level + 1))

        return go(0, 0)

    def _walked(self, bins: Column, depth: int | None) -> Column:
        top = max(self.splits) + 1
        f, cut, low = ([self.splits[i][k] if i in self.splits else None for i in range(top)] for k in range(3))
        f, cut, low = _fixed(f, "int"), _fixed(cut, "int"), _fixed([None if x is None else -1 if x else 0 for x in low], "int")
        levels = top.bit_length() if depth is None else min(depth, top.bit_length())
        if not levels:
            return F.lit(0)

        def step(i: Column, _) -> Column:
            b = F.get(bins, F.get(f, i))
            return F.when(F.get(f, i).isNull(), i).otherwise(F.when(b.between(F.get(low, i), F.get(cut, i)), 2 * i + 1).otherwise(2 * i + 2))

        return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.lit(0), step)

    def margin(self, bins: Column) -> Column:
        """What the tree adds to the margin of a row."""
        if not self.values:
            return F.lit(0.0)
        values = _fixed([self.values.get(i) for i in range(max(self.values) + 1)], "double")
        return F.get(values, self.node(bins))


def _fixed(values: list, kind: str) -> Column:
    """A constant array, made once for a plan whatever its length."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


@dataclass
class Model:
    features: list[str]
    cuts: list[list[float]]
    base: float
    trees: list[Tree]
    best_round: int          # trees that count
    history: list[float]     # AUC of the 'val' rows after each round, where it was watched

    def predict(self, df: DataFrame, name: str = "p1") -> DataFrame:
        """``df`` with the probability of the positive class. Trees are added in stored steps of
        ``SAVE_ROUNDS``, so that no expression grows with the number of rounds."""
        out = df.withColumns({"_bins": bin_array(self.features, self.cuts), "_margin": F.lit(self.base)})
        used = self.trees[: self.best_round]
        for k in range(0, len(used), SAVE_ROUNDS):
            out = out.withColumn("_margin", _plus(F.col("_margin"), used[k : k + SAVE_ROUNDS]))
            if k + SAVE_ROUNDS < len(used):
                out = materialize(out, "margins")
        return out.withColumn(name, _sigmoid(F.col("_margin"))).drop("_bins", "_margin")


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _plus(margin: Column, trees: list[Tree]) -> Column:
    for t in trees:
        margin = margin + t.margin(F.col("_bins"))
    return margin


def cut_points(df: DataFrame, features: list[str], bins: int, error: float = SKETCH_ERROR) -> list[list[float]]:
    """Up to ``bins - 1`` rising cut points per feature, from one sketch of its known values. A value
    belongs to the bin of how many cut points lie at or below it."""
    probs = [i / bins for i in range(1, bins)]
    known = df.select(*[_known(f).alias(f"_f{i}") for i, f in enumerate(features)])
    found = known.stat.approxQuantile(known.columns, probs, error) if features else []
    return [sorted(set(x)) for x in found]


def _known(feature: str) -> Column:
    c = F.col(f"`{feature}`").cast("double")
    return F.when(~F.isnan(c), c)


def bin_array(features: list[str], cuts: list[list[float]]) -> Column:
    """Bins of a row, -1 for a missing value."""
    one = lambda f, c: F.coalesce(F.when(_known(f).isNotNull(), F.size(F.filter(F.lit(c) if c else F.array().cast("array<double>"), lambda x: x <= _known(f)))), F.lit(-1))
    return F.array(*[one(f, c) for f, c in zip(features, cuts)])


def _threshold(g: Column, l1: float) -> Column:
    """The gradient sum, drawn towards 0 by the L1 weight."""
    return F.signum(g) * F.greatest(F.abs(g) - F.lit(l1), F.lit(0.0))


def _score(g: Column, h: Column, s: Settings) -> Column:
    return F.when(h + F.lit(s.l2) > 0, _threshold(g, s.l1) ** 2 / (h + F.lit(s.l2))).otherwise(0.0)


def histograms(rows: DataFrame, features: list[int], nodes: list[int]) -> DataFrame:
    """``node``, ``f``, ``b``, ``g``, ``h``: sums per open node, feature and bin. ``rows`` has ``_node``,
    ``_bins``, ``_g``, ``_h``."""
    picked = F.array(*[F.struct(F.lit(f).alias("f"), F.get("_bins", f).alias("b")) for f in features])
    each = rows.where(F.col("_node").isin(nodes)).select(F.col("_node").alias("node"), "_g", "_h", F.explode(picked).alias("x"))
    return each.groupBy("node", "x.f", "x.b").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h"))


def best_splits(sums: DataFrame, s: Settings) -> DataFrame:
    """Per node the split of the largest gain: ``node``, ``gain``, ``f``, ``cut``, ``missing_left``, the sums ``gt``,
    ``ht`` of the node and ``gl``, ``hl`` of its left side. Among equal gains the first feature, the lowest cut
    and missing values to the left win. A node that nothing splits has a null gain."""
    over = Window.partitionBy("node", "f")
    upto = over.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gone = F.col("b") < 0
    run = sums.select(
        "node", "f", "b", F.sum("g").over(over).alias("gt"), F.sum("h").over(over).alias("ht"),
        F.coalesce(F.sum(F.when(gone, F.col("g"))).over(over), F.lit(0.0)).alias("gm"), F.coalesce(F.sum(F.when(gone, F.col("h"))).over(over), F.lit(0.0)).alias("hm"),
        F.coalesce(F.sum(F.when(~gone, F.col("g"))).over(upto), F.lit(0.0)).alias("gk"), F.coalesce(F.sum(F.when(~gone, F.col("h"))).over(upto), F.lit(0.0)).alias("hk"),
    )
    sides = F.array(*[F.struct(F.lit(left).alias("missing_left"), (F.col("gk") + (F.col("gm") if left else 0)).alias("gl"), (F.col("hk") + (F.col("hm") if left else 0)).alias("hl")) for left in (True, False)])
    each = run.select("node", "f", F.col("b").alias("cut"), "gt", "ht", F.explode(sides).alias("x")).select("node", "f", "cut", "gt", "ht", "x.*")
    gr, hr = F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")
    gain = 0.5 * (_score(F.col("gl"), F.col("hl"), s) + _score(gr, hr, s) - _score(F.col("gt"), F.col("ht"), s)) - F.lit(s.min_gain)
    fits = (F.col("hl") >= s.min_hessian) & (hr >= s.min_hessian) & (F.col("hl") > 0) & (hr > 0) & (F.round(gain, 12) > 0)
    # Rounded, so that the last bits of a sum do not choose between equal splits.
    rank = F.struct(F.round(F.when(fits, gain), 9).alias("gain"), (-F.col("f")).alias("f"), (-F.col("cut")).alias("c"), "missing_left")
    best = each.groupBy("node").agg(F.max_by(F.struct(F.when(fits, gain).alias("gain"), "f", "cut", "missing_left", "gl", "hl"), rank).alias("s"), F.first("gt").alias("gt"), F.first("ht").alias("ht"))
    return best.select("node", "s.*", "gt", "ht")


def leaf_value(g: float, h: float, s: Settings) -> float:
    drawn = (abs(g) - s.l1 if abs(g) > s.l1 else 0.0) * (1 if g > 0 else -1)
    return -s.step * drawn / (h + s.l2) if h + s.l2 > 0 else 0.0


def grow(rows: DataFrame, features: list[int], s: Settings) -> Tree:
    """One tree from rows with ``_bins``, ``_g``, ``_h``; one aggregate a level."""
    tree, nodes = Tree(), [0]
    for level in range(s.depth):
        placed = rows.withColumn("_node", tree.node(F.col("_bins"), level))
        found = best_splits(histograms(placed, features, nodes), s).collect()  # a row per open node
        nodes = []
        for r in sorted(found, key=lambda r: r["node"]):
            i = r["node"]
            if r["gain"] is None:
                tree.values[i] = leaf_value(r["gt"], r["ht"], s)
                continue
            tree.splits[i] = (r["f"], r["cut"], r["missing_left"])
            tree.values.pop(i, None)
            # Leaves for now: the next level may split them.
            tree.values[2 * i + 1] = leaf_value(r["gl"], r["hl"], s)
            tree.values[2 * i + 2] = leaf_value(r["gt"] - r["gl"], r["ht"] - r["hl"], s)
            nodes += [2 * i + 1, 2 * i + 2]
        if not nodes:
            break
    return tree


# --- fixed values: settings of the three compared models ---
MODEL_SETTINGS = {
    "raw": Settings(rounds=400, depth=8, step=0.0023, column_share=0.95, min_hessian=12, row_share=0.673, l1=0.01, l2=0.001, patience=20),
    "embed": Settings(rounds=435, depth=12, step=0.03774, column_share=0.587, min_hessian=2.61, row_share=0.569, l1=0.01364, l2=9.7e-05, min_gain=1.7, patience=20),
    "combined": Settings(rounds=512, depth=12, step=0.00305, column_share=0.768, min_hessian=25.85, row_share=0.65, l1=0.01, l2=0.0001, min_gain=4.8, patience=20),
}


def vector_columns(df: DataFrame, vector: str, k: int) -> tuple[DataFrame, list[str]]:
    """``df`` with the entries of an array column as columns, and their names."""
    names = [f"{vector}_{i}" for i in range(k)]
    return df.withColumns({n: F.get(vector, i).cast("double") for i, n in enumerate(names)}), names


def _share(key: Column, seed: int, share: float) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(_SALT)) < int(share * _SALT)


def _columns(n: int, seed: int, share: float) -> list[int]:
    """The features of a tree: those of the least seeded hashes."""
    order = sorted(range(n), key=lambda f: hashlib.md5(f"{seed}:{f}".encode()).digest())
    return sorted(order[: max(1, round(share * n))]) if n else []


def fit(
    df: DataFrame, features: list[str], label: str = "label", key: str = "row_id", settings: Settings = Settings(), cuts: list[list[float]] | None = None
) -> Model:
    """Trees for a 0/1 label, fitted on ``split = 'train'``; with ``patience``, fitting ends when the AUC of
    the 'val' rows has not risen for that many rounds, and the best round counts.

    Missing and undefined values are learned (see :func:`best_splits`); rows without a label take no part. A
    tree sees the rows whose seeded hash of ``key`` falls into ``row_share``. ``cuts`` are rising cut
    points per feature, from a sketch if not given. Labels of one kind, or no rows, give a model of
    its base value alone.
    """
    s = settings
    rows = df.where(F.col("split").isin("train", "val") & F.col(label).isNotNull())
    cuts = cut_points(rows.where("split = 'train'"), features, s.bins) if cuts is None else cuts
    y = F.col(label).cast("double")
    data = materialize(rows.select(F.col(key).alias("_key"), F.col("split").alias("_split"), y.alias("_y"), bin_array(features, cuts).alias("_bins"), F.lit(0.0).alias("_margin")), "binned")
    sums = data.where("_split = 'train'").agg(F.sum(F.when(F.col("_y") > 0, s.positive_weight)).alias("p"), F.count_if(F.col("_y") <= 0).alias("n")).first()
    positive, negative = float(sums["p"] or 0), float(sums["n"] or 0)
    if not positive or not negative:
        return Model(features, cuts, 0.0 if not positive + negative else (20.0 if positive else -20.0), [], 0, [])
    model = Model(features, cuts, 0.0, [], 0, [])
    weight = F.when(F.col("_y") > 0, s.positive_weight).otherwise(1.0)
    since: list[Tree] = []
    for k in range(s.rounds):
        now = data.withColumn("_margin", _plus(F.col("_margin"), since))
        if len(since) == SAVE_ROUNDS:
            data, since = materialize(now, "margins"), []
            now = data
        p = _sigmoid(F.col("_margin"))
        train = now.where((F.col("_split") == "train") & _share(F.col("_key"), s.seed + k, s.row_share))
        train = train.select("_bins", (weight * (p - F.col("_y"))).alias("_g"), (weight * p * (1 - p)).alias("_h"))
        tree = grow(train, _columns(len(features), s.seed + k, s.column_share), s)
        model.trees.append(tree)
        since.append(tree)
        if s.patience is None:
            model.best_round = k + 1
            continue
        val = data.where("_split = 'val'").select(_sigmoid(_plus(F.col("_margin"), since)).alias("p"), F.col("_y").cast("int").alias("y"))
        model.history.append(ranking_metrics(val, "p", "y").first()["auc"] or 0.0)
        if model.history[-1] > max(model.history[: model.best_round][-1:] or [float("-inf")]):
            model.best_round = k + 1
        elif k + 1 - model.best_round >= s.patience:
            break
    return model
