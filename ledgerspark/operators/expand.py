"""Nested user records to one row per transaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import clean
from ..functions.constants import DERIVED_NAMES, RAW_TIME_COLUMNS, TXN_ARITY, TXN_FIELDS


ROUTES = ("kept", "short", "empty")


def positional_columns(txn: str = "txn") -> list[Column]:
    """Named columns for positions 0..19. Numbers arrive as JSON text such as
    ``1.7E9``, so integers are cast by way of double."""
    out = []
    for i, name, _, kind in TXN_FIELDS:
        v = F.get(txn, i)
        if kind == "int":
            v = v.cast("double").cast("int")
        elif kind == "double":
            v = v.cast("double")
        out.append(v.alias(name))
    return out


def checked_txn(txn: str, position: str = "seq_order") -> Column:
    """The transaction itself; one with too few fields raises when it is read."""
    message = F.concat(
        F.lit("trans["), F.col(position).cast("string"), F.lit("] has only "),
        F.size(txn).cast("string"), F.lit(f" fields; need >= {TXN_ARITY}"),
    )
    return F.when(
        F.coalesce(F.size(txn), F.lit(0)) < TXN_ARITY, F.raise_error(message).cast("array<string>")
    ).otherwise(F.col(txn))


def _exploded(records: DataFrame, gaps: bool = False, keep_empty: bool = False) -> DataFrame:
    start = F.coalesce(F.col("start"), F.lit(0)) if "start" in records.columns else F.lit(0)
    before = F.col("prev_ts") if "prev_ts" in records.columns else F.lit(None).cast("double")
    there = lambda rows: rows if keep_empty else rows.where(F.col("seq_order").isNotNull())
    placed = lambda rows: there(rows).withColumn("seq_order", F.col("seq_order") + F.col("_start")).drop("_start")
    if not gaps:
        # The outer form, filtered afterwards: for the inner form the optimizer adds a filter on
        # the array's size below, which would parse every JSON line twice.
        rows = records.select(
            F.col("cert_sm3").alias("user_id"), "label", start.alias("_start"), F.posexplode_outer("trans").alias("seq_order", "txn")
        )
        return placed(rows)
    time = lambda t: F.get(t, 9).cast("double")
    gap = lambda t, i: F.greatest(
        F.coalesce(time(t) - F.when(i > 0, time(F.get("trans", i - 1))).otherwise(before), F.lit(0.0)), F.lit(0.0)
    )
    both = F.transform("trans", lambda t, i: F.struct(t.alias("txn"), gap(t, i).alias("gap")))
    rows = placed(records.select(F.col("cert_sm3").alias("user_id"), "label", start.alias("_start"), F.posexplode_outer(both).alias("seq_order", "_e")))
    return rows.select("user_id", "label", "seq_order", F.col("_e.txn").alias("txn"), F.col("_e.gap").alias("time_delta_s"))


def short_transactions(records: DataFrame) -> DataFrame:
    """Transactions ``expand_records`` refuses."""
    return _exploded(records).where(F.coalesce(F.size("txn"), F.lit(0)) < TXN_ARITY)


def expand_records(
    records: DataFrame, strict: bool = True, drop_time_columns: bool = False, gaps: bool = False
) -> DataFrame:
    """One row per transaction with user, label and 0-based ``seq_order``, which goes on
    through the records of a history that comes in parts. Records without transactions give no rows. Narrow: no shuffle. ``gaps`` adds the seconds since
    the record's previous transaction, read from the neighbouring array entry."""
    rows = _exploded(records, gaps)
    if strict:
        rows = rows.withColumn("txn", checked_txn("txn"))
    else:
        rows = rows.where(F.coalesce(F.size("txn"), F.lit(0)) >= TXN_ARITY)
    extra = ["time_delta_s"] if gaps else []
    flat = rows.select("user_id", "label", F.col("seq_order").cast("int").alias("seq_order"), *extra, *positional_columns())
    flat = flat.withColumns(
        {
            "dow": clean.weekday_from_parts(F.col("year"), F.col("month"), F.col("day")).cast("int"),
            "period": clean.day_quarter(F.col("hour"), F.col("minutes"), F.col("seconds")).cast("int"),
        }
    )
    return flat.drop(*RAW_TIME_COLUMNS) if drop_time_columns else flat


def route_records(records: DataFrame, path: str, gaps: bool = False) -> dict[str, int]:
    """Good transactions, rejects and counts in one pass over ``records``.

    Writes one table at ``path``, partitioned by ``status``: ``kept`` rows as ``expand_records`` gives
    them, ``short`` rows (too few fields, or none) with their raw ``txn``, and ``empty`` rows, one per
    record without transactions, whose ``seq_order`` is null. Returns the numbers of rows by status,
    taken by Spark as the rows pass by; a task that runs twice counts once.
    """
    rows = _exploded(records, gaps, keep_empty=True)
    status = F.when(F.col("seq_order").isNull(), "empty").when(F.coalesce(F.size("txn"), F.lit(0)) < TXN_ARITY, "short").otherwise("kept")
    rows = rows.withColumn("status", status)
    extra = ["time_delta_s"] if gaps else []
    kept = F.col("status") == "kept"
    fields = F.when(kept, F.col("txn"))
    flat = rows.select(
        "status", "user_id", "label", F.col("seq_order").cast("int").alias("seq_order"), *extra, F.when(~kept, F.col("txn")).alias("txn"), fields.alias("_txn")
    )
    flat = flat.select(*[c for c in flat.columns if c != "_txn"], *positional_columns("_txn"))
    flat = flat.withColumns(
        {
            "dow": clean.weekday_from_parts(F.col("year"), F.col("month"), F.col("day")).cast("int"),
            "period": F.when(F.col("status") == "kept", clean.day_quarter(F.col("hour"), F.col("minutes"), F.col("seconds"))).cast("int"),
        }
    )
    seen = Observation()
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ROUTES]
    flat.observe(seen, *counts).write.partitionBy("status").parquet(path)
    return {s: int(seen.get[s]) for s in ROUTES}


def routed(spark: SparkSession, path: str, status: str) -> DataFrame:
    """The rows of one status that ``route_records`` wrote; the scan reads that folder alone."""
    rows = spark.read.parquet(path).where(F.col("status") == status).drop("status")
    return rows.drop("txn") if status == "kept" else rows.select("user_id", "label", "seq_order", "txn")


def source_names(df: DataFrame) -> DataFrame:
    """Rename working columns back to the names of the source format."""
    names = {name: source for _, name, source, _ in TXN_FIELDS} | DERIVED_NAMES
    return df.toDF(*[names.get(c, c) for c in df.columns])


def empty_users(records: DataFrame) -> DataFrame:
    """Number of records that hold no transactions."""
    gone = F.coalesce(F.size("trans"), F.lit(0)) <= 0
    return records.agg(F.count_if(gone).alias("n_dropped"), F.count(F.lit(1)).alias("n_records"))


def require_transactions(rows: DataFrame) -> DataFrame:
    """Raise when there is not a single row; looks at one row only."""
    if rows.isEmpty():
        raise ValueError("no transactions found: every record has an empty 'trans'")
    return rows


def amount_series(df: DataFrame, column: str = "amount") -> DataFrame:
    if column not in df.columns:
        raise KeyError(f"amount column {column!r} is missing")
    return df.select(F.col(column))
