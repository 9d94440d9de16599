"""Splits by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import clean
from .ordered import HOT_ROWS, quantiles


def with_date(df: DataFrame, name: str = "date") -> DataFrame:
    """Strip header blanks and add the calendar date; an impossible date is null."""
    df = df.toDF(*[c.strip() for c in df.columns])
    return df.withColumn(name, clean.date_from_parts(F.col("Year"), F.col("Month"), F.col("Day")))


def daily_counts(df: DataFrame, date: str = "date") -> DataFrame:
    return df.where(F.col(date).isNotNull()).groupBy(date).agg(F.count(F.lit(1)).alias("n"))


def running_daily(daily: DataFrame, date: str = "date") -> DataFrame:
    """Running row count by day. The table has one row per calendar day, so the window
    without keys is over a few thousand rows at any data size."""
    w = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.withColumn("cumulative", F.sum("n").over(w))


def cutoff_dates(df: DataFrame, ratios: list[float], date: str = "date") -> DataFrame:
    """One row with a column per ratio: the first day on which the running row count
    reaches that share of all dated rows. One pass over the data for all ratios."""
    run = running_daily(daily_counts(df, date), date)
    total = F.max("cumulative").over(Window.partitionBy())
    run = run.withColumn("_total", total)
    return run.agg(
        *[
            F.min(F.when(F.col("cumulative") >= F.col("_total") * F.lit(float(r)), F.col(date))).alias(f"cutoff_{i}")
            for i, r in enumerate(ratios)
        ]
    )


def split_by_date(c1, c2, date: str = "date") -> Column:
    """``< c1`` train, ``[c1, c2)`` val, ``>= c2`` test; no date, no split."""
    d = F.col(date)
    return F.when(d < F.lit(c1), "train").when(d < F.lit(c2), "val").when(d >= F.lit(c2), "test")


def temporal_split_date(
    df: DataFrame, train_ratio: float = 0.8, val_ratio: float = 0.1, date: str = "date"
) -> tuple[DataFrame, tuple]:
    """Rows with a ``split`` column, and the two cutoffs. The cutoffs are read once
    (two dates) so the ranges are literals the optimizer can push down."""
    if date not in df.columns:
        df = with_date(df, date)
    row = cutoff_dates(df, [train_ratio, train_ratio + val_ratio], date).first()
    c1, c2 = row["cutoff_0"], row["cutoff_1"]
    out = df.where(F.col(date).isNotNull()).withColumn("split", split_by_date(c1, c2, date))
    return out.drop(date), (c1, c2)


def temporal_split_quantile(
    df: DataFrame,
    time: str = "unix_ts",
    train_ratio: float = 0.8,
    val_ratio: float = 0.1,
    approximate: bool = False,
    hot_rows: int = HOT_ROWS,
) -> tuple[DataFrame, tuple]:
    """``<= q1`` train, ``(q1, q2]`` val, ``> q2`` test at interpolated time quantiles."""
    probs = [train_ratio, train_ratio + val_ratio]
    if approximate:
        q = df.agg(F.percentile_approx(time, F.lit(probs), F.lit(100_000)).alias("q")).first()["q"]
    else:
        q = quantiles(df, time, probs, hot_rows)
    q = q or [None, None]  # no row has a time
    t = F.col(time)
    split = F.when(t <= F.lit(q[0]).cast("double"), "train").when(t <= F.lit(q[1]).cast("double"), "val").when(t > F.lit(q[1]).cast("double"), "test")
    return df.where(t.isNotNull() & ~F.isnan(t.cast("double"))).withColumn("split", split), tuple(q)


def split_stats(df: DataFrame, label: Column | None = None) -> DataFrame:
    """Rows, share of all rows, positives and rate per split, and a total row."""
    label = clean.yes_flag(F.col("Is Fraud?")) if label is None else label
    per = df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(label.cast("bigint")).alias("n_pos"))
    # Three rows from here on.
    both = per.rollup("split").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_pos").alias("n_pos"))
    both = both.withColumn("split", F.coalesce(F.col("split"), F.lit("total")))
    total = F.max("n_rows").over(Window.partitionBy())
    return both.select(
        "split",
        "n_rows",
        (F.col("n_rows") / total * 100).alias("pct"),
        "n_pos",
        (F.col("n_pos") / F.col("n_rows") * 100).alias("rate_pct"),
    )
