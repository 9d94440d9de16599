"""Ordered scans that do not depend on how large a single key is.

A window over ``PARTITION BY user`` puts a whole user into one task, and a window
without keys puts the whole table there. ``ordered_scan`` first looks for keys
above a row limit. Without any, it is one plain window (one shuffle). Otherwise the
rows of the large keys are cut into ordered parts at sampled boundaries, every part
is scanned on its own, and the few totals per part (rows, sums, last values) are
carried into the following part by a join of one row per part. Without keys the parts
are Spark's range partitions, stored, so a row costs no look at an array of boundaries. Results are
the same either way: the boundaries only decide where the work is cut.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

HOT_ROWS = 1_000_000       # rows of one key that still count as one task's work
SAMPLE_PER_PART = 20
BROADCAST_PARTS = 65_536   # parts of all hot keys up to which boundaries are sent to every task
TABLE_PARTS = 1024         # parts of a table without keys; more only where they would exceed HOT_ROWS


@dataclass
class HotKeys:
    """Keys above the row limit with their row counts: a stored table (keys, ``_n``)."""

    keys: list[str]
    table: DataFrame | None = None
    count: int = 0
    rows: int = 0  # of all hot keys together

    def __bool__(self) -> bool:
        return self.count > 0

    def side(self, df: DataFrame, hot_rows: int) -> DataFrame:
        """``df`` with a row per key or part, sent to every task while there are few."""
        return F.broadcast(df) if self.count + self.rows // max(hot_rows, 1) <= BROADCAST_PARTS else df


# For rows already limited to a fixed number per key.
NO_HOT_KEYS = HotKeys([])


def find_hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> HotKeys:
    """One aggregate over the key columns only; partial counts are combined map-side."""
    counts = (
        (df.groupBy(*keys) if keys else df.groupBy(F.lit(0).alias("_all")))
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > hot_rows)
    )
    facts = counts.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()
    table = materialize(counts, "hot_keys") if facts["k"] else None
    return HotKeys(list(keys), table, facts["k"], facts["n"])


def _order_struct(order: list[Column]) -> Column:
    return F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])


def _cut_points(df: DataFrame, hot: HotKeys, order: Column, hot_rows: int) -> DataFrame:
    """(keys, cuts array<array<struct>>): ordered boundaries per hot key, two levels deep
    so that locating a part takes about 2*sqrt(parts) comparisons. They come from a sample of
    SAMPLE_PER_PART rows for each part, gathered per key by Spark."""
    fraction = min(1.0, SAMPLE_PER_PART / hot_rows)
    named = [F.col(k).alias(f"_h_{k}") for k in hot.keys]
    parts = F.greatest(F.lit(2), F.ceil(F.col("_n") / hot_rows)).cast("int").alias("_parts")
    hot_df = hot.side(hot.table.select(*named, parts), hot_rows)
    same = lambda other: _null_safe_all([(F.col(f"{other}{k}"), F.col(f"_h_{k}")) for k in hot.keys])
    picked = df.select(*[F.col(k).alias(f"_s_{k}") for k in hot.keys], order.alias("_o")).join(hot_df, same("_s_"), "left_semi")
    picked = picked.sample(fraction, seed=7) if fraction < 1 else picked
    seen = picked.groupBy(*[f"_s_{k}" for k in hot.keys]).agg(F.collect_list("_o").alias("_seen"))
    flat = hot.table.select(*named, parts).join(seen, same("_s_"), "left")
    # Spark's own ordering decides what "sorted" means, so it matches the scan's.
    empty = F.array().cast(seen.schema["_seen"].dataType)
    flat = flat.withColumn("_seen", F.array_sort(F.coalesce("_seen", empty)))
    every = F.greatest(F.lit(1), F.floor(F.size("_seen") / F.col("_parts"))).cast("int")
    flat = flat.withColumn(
        "_flat", F.array_distinct(F.filter("_seen", lambda _, i: (i + 1) % every == 0))
    )
    width = F.greatest(F.lit(1), F.floor(F.sqrt(F.size("_flat")))).cast("int")
    nested = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("_flat") - 1) / width)).cast("int")),
        lambda i: F.slice("_flat", i * width + 1, width),
    )
    cuts = flat.select(*[F.col(f"_h_{k}").alias(k) for k in hot.keys], F.filter(nested, lambda g: F.size(g) > 0).alias("_cuts"))
    # Stored: parts must be the same wherever they are looked up.
    return materialize(cuts, "cuts")


def _null_safe_all(pairs) -> Column:
    cond = F.lit(True)
    for a, b in pairs:
        cond = cond & a.eqNullSafe(b)
    return cond


def _locate(cuts: Column, key: Column) -> Column:
    """Index of the part ``key`` falls in: number of boundaries at or below it."""
    outer = F.size(F.filter(cuts, lambda g: F.element_at(g, 1) <= key))
    block = F.size(F.try_element_at(cuts, F.lit(1)))
    inner = F.size(F.filter(F.element_at(cuts, outer), lambda c: c <= key))
    return F.when(outer == 0, 0).otherwise((outer - 1) * block + inner)


def _parts_of_keys(df: DataFrame, hot: HotKeys, order: Column, hot_rows: int) -> DataFrame:
    """``df`` with ``_part`` by its hot key's boundaries (-1: the key is not hot) and the order as ``_o``."""
    cuts = _cut_points(df, hot, order, hot_rows)
    renamed = cuts.select(*[F.col(k).alias(f"_h_{k}") for k in hot.keys], "_cuts")
    tagged = df.withColumn("_o", order)
    # One row per hot key with a boundary for each part.
    tagged = tagged.join(
        hot.side(renamed, hot_rows), _null_safe_all([(F.col(k), F.col(f"_h_{k}")) for k in hot.keys]), "left"
    )
    return tagged.withColumn(
        "_part", F.when(F.col("_cuts").isNull(), -1).otherwise(_locate(F.col("_cuts"), F.col("_o")))
    ).drop("_cuts", *[f"_h_{k}" for k in hot.keys])


def _parts_of_table(df: DataFrame, rows: int, order: list[Column], hot_rows: int) -> DataFrame:
    """``df`` with the range partition a row falls in (``_part``) and the order as ``_o``. Stored, as Spark
    may draw the boundaries anew wherever the rows are computed again."""
    parts = max(2, min(-(-rows // hot_rows), max(TABLE_PARTS, -(-rows // HOT_ROWS))))
    ranged = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    return materialize(ranged, "parts").withColumn("_o", _order_struct(order))


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    *,
    position: str | None = None,
    previous: dict[str, str] | None = None,
    sums: dict[str, str] | None = None,
    hot_rows: int = HOT_ROWS,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Add per-key ordered columns.

    ``position`` is the 0-based rank, ``previous`` maps new columns to the column whose
    value on the preceding row they hold, ``sums`` maps new columns to the column they
    accumulate (the current row included). ``order`` must identify a row within its key
    and is ascending with nulls first; descending numbers are passed negated.
    """
    previous, sums = previous or {}, sums or {}
    hot = find_hot_keys(df, keys, hot_rows) if hot is None else hot
    if not hot:
        return _scan_plain(df, keys, order, position, previous, sums)

    out_cols = df.columns
    tagged = _parts_of_keys(df, hot, _order_struct(order), hot_rows) if keys else _parts_of_table(df, hot.rows, order, hot_rows)

    part_keys = [*keys, "_part"]
    carry = F.struct(*[F.col(c).alias(n) for n, c in previous.items()]) if previous else F.lit(0)
    totals = (
        tagged.where(F.col("_part") >= 0)
        .groupBy(*part_keys)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()],
            F.max_by(carry, F.col("_o")).alias("_last"),
        )
    )
    w = Window.partitionBy(*keys).orderBy("_part") if keys else Window.orderBy("_part")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_h_{k}") for k in part_keys],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_s0_{n}") for n in sums],
        F.lag("_last").over(w).alias("_carry"),
    )
    scanned = _scan_plain(tagged, part_keys, order, "_pos", previous, sums)
    # One row per part.
    scanned = scanned.join(
        hot.side(offsets, hot_rows), _null_safe_all([(F.col(k), F.col(f"_h_{k}")) for k in part_keys]), "left"
    )
    new = {}
    if position:
        new[position] = (F.col("_pos") + F.coalesce(F.col("_n0"), F.lit(0))).cast("bigint")
    for n in previous:
        new[n] = F.when(F.col("_pos") == 0, F.col(f"_carry.{n}")).otherwise(F.col(n))
    for n in sums:
        new[n] = F.col(n) + F.coalesce(F.col(f"_s0_{n}"), F.lit(0))
    return scanned.select(
        *[F.col(f"`{c}`") for c in out_cols], *[e.alias(n) for n, e in new.items()]
    )


def _scan_plain(df, keys, order, position, previous, sums) -> DataFrame:
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(*order)
    new = {}
    if position:
        new[position] = (F.row_number().over(w) - 1).cast("bigint")
    for n, c in previous.items():
        new[n] = F.lag(c).over(w)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for n, c in sums.items():
        new[n] = F.sum(c).over(running)
    return df.withColumns(new)


def global_rank(df: DataFrame, order: list[Column], name: str = "line_idx", **kw) -> DataFrame:
    """0-based rank over a total order of the whole table."""
    return ordered_scan(df, [], order, position=name, **kw)


def global_prefix_sum(df: DataFrame, order: list[Column], sums: dict[str, str], **kw) -> DataFrame:
    """Running totals over a total order of the whole table."""
    return ordered_scan(df, [], order, sums=sums, **kw)


def quantiles(df: DataFrame, column: str, probs: list[float], hot_rows: int = HOT_ROWS) -> list[float]:
    """Exact linearly interpolated quantiles of the non-null values.

    Equal values are counted before anything else. While the distinct values fit one
    task, the built-in weighted ``percentile`` does the rest; beyond that, running
    counts over ordered parts pick out just the values at the wanted ranks.
    """
    x = F.col(column).cast("double")
    counts = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(x.alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    counts = materialize(counts, "values")
    size = counts.agg(F.count(F.lit(1)).alias("m"), F.sum("_c").alias("n")).first()
    if not size["m"]:
        return []
    if size["m"] <= hot_rows:
        arr = F.array(*[F.lit(float(p)) for p in probs])
        return list(counts.agg(F.percentile("_x", arr, F.col("_c")).alias("q")).first()["q"])
    ranks = [p * (size["n"] - 1) for p in probs]
    wanted = sorted({int(r) for r in ranks} | {min(int(r) + 1, size["n"] - 1) for r in ranks})
    cum = global_prefix_sum(counts, [F.col("_x")], {"_cum": "_c"}, hot_rows=hot_rows)
    want = F.broadcast(df.sparkSession.createDataFrame([(w,) for w in wanted], "_r bigint"))
    hits = cum.join(want, (F.col("_r") < F.col("_cum")) & (F.col("_r") >= F.col("_cum") - F.col("_c")))
    at = {r["_r"]: r["_x"] for r in hits.select("_r", "_x").collect()}
    out = []
    for r in ranks:
        lo, hi = int(r), min(int(r) + 1, size["n"] - 1)
        out.append(at[lo] if lo == r else (hi - r) * at[lo] + (r - lo) * at[hi])
    return out
