"""Exact, reproducible samples.

A row's place in the random order is the md5 of seed and row key, so it depends on
nothing but the row. The first four hex digits cut that order into 65,536 even slices.
Counting the slices (a map-side combined aggregate) tells which one straddles the wanted
size; while that slice is large, its next digits are counted in the same way. The few rows
of the last slice are ranked, and its last key taken is the cut for the whole class. No
class is ever sorted in one task, and the rows themselves are only filtered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .ordered import global_prefix_sum

SLICE_DIGITS = 4
SLICE_ROWS = 100_000   # rows of a slice that are ranked together
LITERAL_CLASSES = 64   # classes whose cuts are literals of a filter; more are joined
BROADCAST_CLASSES = 1_000_000


def shuffle_key(seed: int, *ids: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def _literal(v) -> Column:
    if isinstance(v, Row):
        return F.struct(*[_literal(v[c]).alias(c) for c in v.__fields__])
    return F.lit(v)


def _with_classes(rows: DataFrame, stratum: str, classes: DataFrame, name: str, columns: list[str], keep) -> DataFrame:
    """``rows`` with the ``columns`` of their class, filtered by ``keep(columns)``. ``classes`` has a row
    per class, its key in ``name``. Few classes become literals, so nothing is joined; more are
    broadcast while their number allows it."""
    found = classes.limit(LITERAL_CLASSES + 1).collect()
    if len(found) <= LITERAL_CLASSES:
        same = lambda r: F.col(stratum).eqNullSafe(_literal(r[name]).cast(classes.schema[name].dataType))
        out = rows
        for c in columns:
            value = F.lit(None).cast(classes.schema[c].dataType)
            for r in found:
                value = F.when(same(r), F.lit(r[c])).otherwise(value)
            out = out.withColumn(c, value)
        return out.where(keep)
    side = F.broadcast(classes) if classes.count() <= BROADCAST_CLASSES else classes
    return rows.join(side, F.col(stratum).eqNullSafe(F.col(name))).where(keep)


def take_exact(
    df: DataFrame, quotas: Callable[[DataFrame], DataFrame], stratum: Column, ids: list[str], seed: int = 42, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """A wanted number of rows of every stratum, the first in seeded order.

    ``quotas`` turns the row counts (``stratum``, ``n``), one row per class, into
    (``stratum``, ``quota``). Slices are counted once and stored, the last key to take is
    looked up per class, and then the rows are only filtered: they are never sorted or shuffled.
    """
    key = shuffle_key(seed, *ids)
    slim = df.select(stratum.alias("stratum"), key.alias("_key"))
    count = F.count(F.lit(1)).alias("n")

    def straddling(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
        """(_es, _prefix, _need, _n): the slice of each class that holds the last row wanted."""
        w = Window.partitionBy("stratum").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("n").over(w), F.lit(0))
        at = sizes.withColumn("_before", before).join(wanted, F.col("stratum").eqNullSafe(F.col("_q")))
        at = at.where((F.col("_before") < F.col("quota")) & (F.col("quota") <= F.col("_before") + F.col("n")))
        return materialize(at.select(F.col("stratum").alias("_es"), F.col("_slice").alias("_prefix"), (F.col("quota") - F.col("_before")).alias("_need"), F.col("n").alias("_n")), "edges")

    # Classes times 65,536 slices at most.
    digits = SLICE_DIGITS
    sizes = materialize(slim.groupBy("stratum", F.substring("_key", 1, digits).alias("_slice")).agg(count), "slices")
    q = quotas(sizes.groupBy("stratum").agg(F.sum("n").alias("n"))).where(F.col("quota") > 0)
    edges = straddling(sizes, q.select(F.col("stratum").alias("_q"), "quota"))
    inside = lambda d: F.substring("_key", 1, d) == F.col("_prefix")
    while digits < 32 and (edges.agg(F.max("_n")).first()[0] or 0) > slice_rows:
        rows = _with_classes(slim, "stratum", edges, "_es", ["_prefix"], inside(digits)).select("stratum", "_key")
        digits += SLICE_DIGITS
        sizes = rows.groupBy("stratum", F.substring("_key", 1, digits).alias("_slice")).agg(count)
        edges = straddling(sizes, edges.select(F.col("_es").alias("_q"), F.col("_need").alias("quota")))
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy("_key"))
    last = _with_classes(slim, "stratum", edges, "_es", ["_prefix", "_need"], inside(digits)).withColumn("_rank", rank)
    # One row per class; a class without rows to take is absent.
    cuts = materialize(last.where(F.col("_rank") == F.col("_need")).select(F.col("stratum").alias("_q"), F.col("_key").alias("_cut")), "cuts")
    kept = df.withColumn("_key", key).withColumn("_stratum", stratum)
    kept = _with_classes(kept, "_stratum", cuts, "_q", ["_cut"], F.col("_key") <= F.col("_cut"))
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])


def balanced_quotas(total: int, ratio: float) -> Callable[[DataFrame], DataFrame]:
    """Positives ``min(P, int(total*ratio))``, negatives ``min(N, total - positives)``."""

    def of(counts: DataFrame) -> DataFrame:
        one = counts.agg(
            F.coalesce(F.sum(F.when(F.col("stratum") == 1, F.col("n"))), F.lit(0)).alias("p"),
            F.coalesce(F.sum(F.when(F.col("stratum") == 0, F.col("n"))), F.lit(0)).alias("n"),
        )
        n_pos = F.least(F.col("p"), F.lit(int(total * ratio)))
        pair = F.array(
            F.struct(F.lit(1).alias("v"), n_pos.alias("q")),
            F.struct(F.lit(0).alias("v"), F.least(F.col("n"), F.lit(total) - n_pos).alias("q")),
        )
        rows = one.select(F.explode(pair).alias("x"))
        return rows.select(F.col("x.v").cast(counts.schema["stratum"].dataType).alias("stratum"), F.col("x.q").alias("quota"))

    return of


def balanced_sample(
    df: DataFrame, label: str = "_target", ids: list[str] = ("row_id",), total: int = 1_000_000,
    ratio: float = 0.1, seed: int = 42, columns: list[str] | None = None,
) -> DataFrame:
    """Features, label and row key of a class-balanced sample without replacement."""
    ids = list(ids)
    picked = take_exact(df, balanced_quotas(total, ratio), F.col(label), ids, seed)
    if columns is None:
        return picked
    keep = list(dict.fromkeys([*ids, label, *columns]))
    return picked.select(*[F.col(f"`{c}`") for c in keep])


def stratified_quotas(n: int, within: Column | None = None) -> Callable[[DataFrame], DataFrame]:
    """Largest-remainder share of ``n`` per class, of ``n`` for each value of ``within``."""

    def of(counts: DataFrame) -> DataFrame:
        every = Window.partitionBy(*([within] if within is not None else []))
        c = counts.withColumn("_total", F.sum("n").over(every)).withColumn("_want", F.least(F.lit(n), F.col("_total")))
        # Integer arithmetic: floor and remainder of n_class * want / total.
        share = F.col("n").cast("decimal(38,0)") * F.col("_want")
        c = c.withColumn("_floor", F.floor(share / F.col("_total")).cast("bigint"))
        c = c.withColumn("_rest", (share - F.col("_floor") * F.col("_total")).cast("decimal(38,0)"))
        c = c.withColumn("_left", F.col("_want") - F.sum("_floor").over(every))
        rank = F.row_number().over(every.orderBy(F.desc("_rest"), F.col("stratum")))
        return c.select("stratum", (F.col("_floor") + F.when(rank <= F.col("_left"), 1).otherwise(0)).alias("quota"))

    return of


def stratified_subsample(df: DataFrame, label: str, n: int, ids: list[str] = ("row_id",), seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows in the class proportions of ``df``; all of it if it has no more."""
    return take_exact(df, stratified_quotas(n), F.col(label), list(ids), seed)


def eval_subsets(df: DataFrame, label: str, n: int = 100_000, ids: list[str] = ("row_id",), seed: int = 42) -> DataFrame:
    """Stratified picks of ``n`` rows each from the val and test splits, raw columns kept;
    both splits share the same passes."""
    held = df.where(F.col("split").isin("val", "test"))
    stratum = F.struct(F.col("split").alias("split"), F.col(label).alias("y"))
    return take_exact(held, stratified_quotas(n, F.col("stratum.split")), stratum, list(ids), seed)


def uniform_subset(df: DataFrame, n: int, ids: list[str] = ("row_id",), seed: int = 42) -> DataFrame:
    """``n`` rows without replacement."""
    everything = lambda counts: counts.select("stratum", F.least(F.lit(n), F.col("n")).alias("quota"))
    return take_exact(df, everything, F.lit(0), list(ids), seed)


def seeded_shuffle(df: DataFrame, ids: list[str] = ("row_id",), seed: int = 42, name: str = "place") -> DataFrame:
    """0-based place of every row in a seeded permutation: slice totals give where a slice
    starts, a window inside the slice does the rest."""
    ids = list(ids)
    key = shuffle_key(seed, *ids)
    # As many digits as keep a slice small, whatever the number of rows.
    n, digits = df.count(), 1
    while n > SLICE_ROWS * 16**digits // 8:
        digits += 1
    part = F.substring(key, 1, digits)
    sizes = materialize(df.select(part.alias("_ps")).groupBy("_ps").agg(F.count(F.lit(1)).alias("_n")), "slices")
    starts = global_prefix_sum(sizes, [F.col("_ps")], {"_through": "_n"}).select("_ps", (F.col("_through") - F.col("_n")).alias("_start"))
    keyed = df.withColumn("_key", key).withColumn("_slice", F.substring("_key", 1, digits))
    placed = keyed.join(F.broadcast(starts) if 16**digits <= BROADCAST_CLASSES else starts, F.col("_slice") == F.col("_ps"))
    rank = F.row_number().over(Window.partitionBy("_slice").orderBy("_key", *ids))
    return placed.withColumn(name, F.col("_start") + rank - 1).drop("_key", "_slice", "_ps", "_start")
