"""Per-key history columns: gaps, positions, chunks, the most recent rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import HOT_ROWS, HotKeys, find_hot_keys, ordered_scan


def nulls_last(*cols: str) -> list[Column]:
    """Order that puts a missing time behind all known ones."""
    out = []
    for c in cols:
        out += [F.col(c).isNull(), F.col(c)]
    return out


def with_gap(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    seconds: str,
    name: str = "time_delta_s",
    position: str | None = None,
    hot_rows: int = HOT_ROWS,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Seconds since the preceding row of the key; first row, missing or negative gap: 0."""
    out = ordered_scan(df, keys, order, position=position, previous={"_prev": seconds}, hot_rows=hot_rows, hot=hot)
    gap = F.greatest(F.coalesce(F.col(seconds) - F.col("_prev"), F.lit(0)), F.lit(0)).cast("double")
    return out.withColumn(name, gap).drop("_prev")


def with_position(df, keys, order, name="pos", hot_rows: int = HOT_ROWS) -> DataFrame:
    return ordered_scan(df, keys, order, position=name, hot_rows=hot_rows)


def chunk_of(pos: Column, chunk_size: int) -> Column:
    return F.floor(pos / F.lit(chunk_size)).cast("int")


def last_n(df: DataFrame, keys: list[str], order: list[Column], n: int = 512, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The ``n`` last rows of every key, in rising order with nulls first.

    Ranks of ordinary keys are cut before the shuffle too, so a task never sends more than
    ``n`` rows of one key. A key above ``hot_rows`` could still bring ``n`` rows from each of very
    many tasks to one: its rows are scanned in parts, and its count tells the places to keep.
    """
    w = Window.partitionBy(*keys).orderBy(*[o.desc_nulls_last() for o in order])
    take = lambda d: d.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= n).drop("_back")
    hot = find_hot_keys(df, keys, hot_rows)
    if not hot:
        return take(df)
    named = [F.col(k).alias(f"_h_{k}") for k in keys]
    large = hot.side(hot.table.select(*named, F.col("_n").alias("_total")), hot_rows)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_h_{k}"))
    placed = ordered_scan(df.join(large, same, "left_semi"), keys, order, position="_at", hot=hot, hot_rows=hot_rows)
    kept = placed.join(large, same).where(F.col("_at") >= F.col("_total") - n)
    return take(df.join(large, same, "left_anti")).unionByName(kept.select(*[F.col(f"`{c}`") for c in df.columns]))


def last_n_of_array(arr: Column, n: int = 512) -> Column:
    """The same on an array column; a negative ``slice`` start would lose short arrays."""
    return F.slice(arr, F.greatest(F.size(arr) - n + 1, F.lit(1)), F.lit(n))


def gap_hours(prev_s: Column, cur_s: Column) -> Column:
    """Whole hours between two times cut to seconds; first row 0, kept in [0, 2^31-1]."""
    d = cur_s.cast("bigint") - prev_s.cast("bigint")
    h = F.coalesce(F.floor(d / F.lit(3600)), F.lit(0))
    return F.least(F.greatest(h, F.lit(0)), F.lit(2**31 - 1)).cast("bigint")


def last_value(df: DataFrame, keys: list[str], value: str, order: list[Column], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(F.col(value), F.struct(*order)).alias(name))


def min_history(records: DataFrame, k: int, arr: str = "trans") -> DataFrame:
    """Keep the records of users with at least ``k`` transactions; decided before anything is
    expanded. Only a history that comes in parts (``start``) is counted over its records."""
    size = F.coalesce(F.greatest(F.size(arr), F.lit(0)), F.lit(0))
    if "start" not in records.columns:
        return records.where(size >= k)
    enough = records.groupBy("cert_sm3").agg(F.sum(size).alias("_n")).where(F.col("_n") >= k).select(F.col("cert_sm3").alias("_user"))
    return records.join(enough, F.col("cert_sm3").eqNullSafe(F.col("_user")), "left_semi")
