"""Summaries of a transaction table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import clean
from .ordered import HOT_ROWS, quantiles


def _distinct(c, approximate: bool) -> Column:
    return F.approx_count_distinct(c) if approximate else F.count_distinct(c)


def dataset_summary(df: DataFrame, user: str = "User", label: Column | None = None, approximate: bool = False) -> DataFrame:
    """Rows, columns, users, positives and rate; columns a table lacks are left out."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("bigint").alias("n_columns")]
    if user in df.columns:
        aggs.append(_distinct(F.col(user), approximate).alias("n_users"))
    if label is None and "Is Fraud?" in df.columns:
        label = F.col("`Is Fraud?`") == "Yes"
    if label is not None:
        pos = F.count_if(label)
        aggs += [pos.alias("n_pos"), F.try_divide(pos, F.count(F.lit(1))).alias("pos_rate")]
    return df.agg(*aggs)


def ndjson_summary(df: DataFrame, user: str = "user_id", label: str = "label", approximate: bool = False) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n_rows"), _distinct(F.col(user), approximate).alias("n_users")]
    if label in df.columns:
        pos = F.count_if(F.col(label) == 1)
        aggs += [pos.alias("n_pos"), F.try_divide(pos, F.count(F.lit(1))).alias("pos_rate")]
    return df.agg(*aggs)


def feature_summary(df: DataFrame, features: list[str], approximate: bool = False) -> DataFrame:
    """Type and distinct count per feature: one aggregate, then one row per feature.

    Exact counts are taken feature by feature over (feature, value) pairs, so a shuffle
    task holds values, not rows; ``approximate`` needs no shuffle of values at all.
    """
    types = F.create_map(*[x for f in features for x in (F.lit(f), F.lit(df.schema[f].dataType.simpleString()))])
    if approximate:
        one = df.agg(*[F.approx_count_distinct(F.col(f"`{f}`")).alias(f"c{i}") for i, f in enumerate(features)])
        pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"c{i}").alias("n")) for i, f in enumerate(features)])
        rows = one.select(F.explode(pairs).alias("p")).select(F.col("p.f").alias("feature"), F.col("p.n").alias("n_unique"))
    else:
        pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"`{f}`").cast("string").alias("v")) for f in features])
        uniq = df.select(F.explode(pairs).alias("p")).select("p.f", "p.v").distinct()
        rows = uniq.groupBy(F.col("f").alias("feature")).agg(F.count("v").alias("n_unique"))
    return rows.select("feature", types[F.col("feature")].alias("dtype"), "n_unique")


def class_distribution(df: DataFrame, label: str = "Is Fraud?") -> DataFrame:
    return df.groupBy(F.col(f"`{label}`").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def fraud_rate_by_mcc(df: DataFrame, min_txns: int = 500, top: int = 15) -> DataFrame:
    """Positive rate in percent of codes with enough transactions, the highest first."""
    flag = clean.yes_flag(F.col("`Is Fraud?`"))
    g = df.where(F.col("MCC").isNotNull()).groupBy("MCC").agg(
        F.count(F.lit(1)).alias("n_txns"), (F.avg(flag) * 100).alias("rate_pct")
    )
    g = g.where(F.col("n_txns") >= min_txns).orderBy(F.desc("rate_pct"), "MCC").limit(top)
    return g.withColumn("label", clean.mcc_display(F.col("MCC")))


def user_counts(df: DataFrame, user: str = "User") -> DataFrame:
    return df.groupBy(user).agg(F.count(F.lit(1)).alias("n"))


def txns_per_user(df: DataFrame, user: str = "User", bins: int = 50, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, int]:
    """Histogram of transactions per user over equal-width bins, and the median."""
    counts = user_counts(df, user).groupBy("n").agg(F.count(F.lit(1)).alias("users"))
    r = counts.agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"),
        F.percentile("n", F.lit(0.5), F.col("users")).alias("median"),
    ).first()
    lo, hi = float(r["lo"]), float(r["hi"])
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    b = F.least(F.width_bucket(F.col("n").cast("double"), F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins)) - 1
    hist = counts.groupBy(b.cast("int").alias("bin")).agg(F.sum("users").alias("n_users"))
    return hist.withColumn("bin_from", F.lit(lo) + F.col("bin") * F.lit((hi - lo) / bins)), int(r["median"])


def monthly_counts(df: DataFrame, cutoffs: tuple = ()) -> DataFrame:
    """Rows per month in order, and which month holds a split cutoff."""
    period = F.concat(F.col("Year").cast("int").cast("string"), F.lit("-"), F.lpad(F.col("Month").cast("int").cast("string"), 2, "0"))
    m = df.where(F.col("Year").isNotNull() & F.col("Month").isNotNull()).groupBy(period.alias("period")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # One row per month.
    m = m.withColumn("pos", (F.row_number().over(Window.orderBy("period")) - 1).cast("int"))
    names = [c.strftime("%Y-%m") for c in cutoffs]
    return m.withColumn("is_cutoff", F.col("period").isin(*names) if names else F.lit(False))
