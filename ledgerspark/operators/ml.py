"""Encoding, reduction and classifiers on top of ``pyspark.ml``."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from . import boosting
from .metrics import model_comparison, ranking_metrics
from .ordered import HOT_ROWS
from .steps import COLLECT_LABELS
from .tokens import fit_categories


def ordinal_encode(df: DataFrame, features: list[str], train: str = "train", hot_rows: int = HOT_ROWS) -> tuple[DataFrame, list[str]]:
    """Text features to the rank of their value among the training values; unseen ones
    are -1 and missing ones stay null. Returns the table and the feature order: encoded columns first,
    then the untouched ones."""
    text = [f for f in features if isinstance(df.schema[f].dataType, T.StringType)]
    rest = [f for f in features if f not in text]
    if text:
        cats = fit_categories(df.where(F.col("split") == train), text, default=None, hot_rows=hot_rows)
        cats = materialize(cats, "categories")
        sizes = {r["column"]: r["n"] for r in cats.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
        for f in text:
            one = cats.where(F.col("column") == f).select(F.col("label").alias("_v"), F.col("local_idx").alias("_i"))
            if sizes.get(f, 0) <= COLLECT_LABELS:
                one = F.broadcast(one)
            c = F.col(f"`{f}`")
            df = df.join(one, c == F.col("_v"), "left")
            code = F.when(c.isNull(), None).otherwise(F.coalesce(F.col("_i"), F.lit(-1))).cast("double")
            df = df.withColumn(f, code).drop("_v", "_i")
    return df, [*text, *rest]


def pca_reduce(df: DataFrame, vector: str = "embedding", k: int = 64, train: str = "train", name: str = "pca") -> tuple[DataFrame, Model, float]:
    """Centred principal components fitted on the training split, applied to all splits.
    Returns the table with an array column, the model and the explained variance."""
    v = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    fit_rows = v.where(F.col("split") == train)
    scaler = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(fit_rows)
    centred = scaler.transform(v)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred.where(F.col("split") == train))
    out = model.transform(centred).withColumn(name, vector_to_array("_p")).drop("_v", "_c", "_p")
    return out, model, float(sum(model.explainedVariance))


def assemble(
    df: DataFrame, features: list[str], vector: str | None = None, k: int = 0, name: str = "features", missing: float = -1.0
) -> DataFrame:
    """Feature vector of plain columns followed by the entries of an array column."""
    cols = {f"_f{i}": F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(missing)) for i, f in enumerate(features)}
    cols |= {f"_v{i}": F.get(vector, i).cast("double") for i in range(k)} if vector else {}
    wide = df.withColumns(cols)
    return VectorAssembler(inputCols=list(cols), outputCol=name, handleInvalid="keep").transform(wide).drop(*cols)


def train_classifier(
    df: DataFrame, features: str = "features", label: str = "label", rounds: int = 100, depth: int = 8,
    step: float = 0.1, subsample: float = 0.7, min_rows: int = 1, seed: int = 42,
) -> tuple[Model, DataFrame]:
    """Boosted trees fitted on ``split = 'train'`` and stopped early on ``'val'``; returns
    the model and the positive-class probability of the val and test rows."""
    data = df.withColumn("_val", F.col("split") == "val").withColumn("_y", F.col(label).cast("double"))
    gbt = GBTClassifier(
        featuresCol=features, labelCol="_y", validationIndicatorCol="_val", maxIter=rounds, maxDepth=min(depth, 30),
        stepSize=step, subsamplingRate=subsample, minInstancesPerNode=min_rows, seed=seed,
    )
    model = gbt.fit(data.where(F.col("split").isin("train", "val")))
    scored = model.transform(data.where(F.col("split") != "train"))
    return model, scored.withColumn("p1", vector_to_array("probability")[1]).drop(
        "_val", "_y", "rawPrediction", "probability", "prediction"
    )


# --- fixed values: rounds, depth, learning rate, row share and leaf size per model ---
MODEL_SETTINGS = {
    "raw": dict(rounds=400, depth=8, step=0.0023, subsample=0.673, min_rows=12),
    "embed": dict(rounds=435, depth=12, step=0.03774, subsample=0.569, min_rows=3),
    "combined": dict(rounds=512, depth=12, step=0.00305, subsample=0.65, min_rows=26),
}


def three_model_comparison(
    df: DataFrame, features: list[str], vector: str = "embedding", label: str = "label", k: int = 64,
    settings: dict | None = None, trees: str = "gbt", key: str = "row_id",
) -> DataFrame:
    """Raw features against reduced vectors against both: a row per model with its metrics,
    best flags and lift over the raw model. ``df`` holds aligned rows with a ``split``.
    ``trees="histogram"`` fits the trees of ``boosting``, with ``Settings`` per model."""
    if trees not in ("gbt", "histogram"):
        raise ValueError(f"unknown trees {trees!r}")
    settings = settings or (MODEL_SETTINGS if trees == "gbt" else boosting.MODEL_SETTINGS)
    reduced, _, _ = pca_reduce(df, vector, k)
    encoded, order = ordinal_encode(reduced, features)
    encoded = materialize(encoded, "features")
    plans = [
        ("raw", "Raw features", dict(features=order), len(order)),
        ("embed", f"{k}d PCA embeddings", dict(features=[], vector="pca", k=k), k),
        ("combined", f"Combined ({len(order)}+{k}d)", dict(features=order, vector="pca", k=k), len(order) + k),
    ]
    rows = []
    for i, (model, title, how, dim) in enumerate(plans):
        if trees == "gbt":
            _, scored = train_classifier(assemble(encoded, **how), label=label, **settings[model])
        else:
            wide, names = boosting.vector_columns(encoded, "pca", k)
            fitted = boosting.fit(wide, [*how["features"], *(names if "vector" in how else [])], label, key, settings[model])
            scored = materialize(fitted.predict(wide.where(F.col("split") != "train")), "scored")
        m = {}
        for split in ("val", "test"):
            r = ranking_metrics(scored.where(F.col("split") == split), "p1", label).first()
            m[split] = (r["auc"], r["ap"])
        rows.append((i, title, dim, *m["val"], *m["test"]))
    results = df.sparkSession.createDataFrame(
        rows, "pos int, model string, feature_dim int, val_auc double, val_ap double, test_auc double, test_ap double"
    )
    return model_comparison(results)
