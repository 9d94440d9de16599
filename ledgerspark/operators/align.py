"""Keyed joins that put features, labels and vectors of the same row together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import LABEL_COLUMNS, POSITIVE_LABELS

BROADCAST_ROWS = 100_000


def label_column(df: DataFrame, prefer: str | None = None) -> str | None:
    order = ([prefer] if prefer else []) + [c for c in LABEL_COLUMNS if c != prefer]
    return next((c for c in order if c in df.columns), None)


def extract_label(df: DataFrame, prefer: str | None = None) -> Column | None:
    """0/1 label of the first known label column: text by its positive spellings,
    numbers as they are; None when there is no such column."""
    name = label_column(df, prefer)
    if name is None:
        return None
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.coalesce(c.isin(*POSITIVE_LABELS), F.lit(False)).cast("int")
    return c.cast("int")


def align(raw: DataFrame, vectors: DataFrame, keys: list[str] = ("split", "row_id")) -> DataFrame:
    """Raw features next to their vectors by the stored row key. Keys are unique on both
    sides, so the join has no hot keys; its strategy is the planner's."""
    return vectors.join(raw, list(keys), "inner")


def keep_rows(raw: DataFrame, picked: DataFrame, keys: list[str] = ("row_id",)) -> DataFrame:
    return raw.join(picked.select(*keys), list(keys), "left_semi")


def lookup(df: DataFrame, value: str, table: DataFrame, key: str, label: str, default, name: str, rows: int | None = None) -> DataFrame:
    """Label of ``value`` in a two-column table, ``default`` where it is missing.

    ``rows`` is the table's size if known, otherwise it is counted; the table is broadcast
    only up to BROADCAST_ROWS and joined by shuffle beyond.
    """
    t = table.select(F.col(key).alias("_k"), F.col(label).alias("_v"))
    n = t.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    if n <= BROADCAST_ROWS:
        t = F.broadcast(t)
    out = df.join(t, F.col(value) == F.col("_k"), "left")
    return out.withColumn(name, F.coalesce(F.col("_v"), F.lit(default))).drop("_k", "_v")
