"""Summaries that are stored per part of the data and merged, so that new data needs no rescan.

A part (a day, a file) is one row: exact counts, least and greatest values, a quantile sketch
(KLL) per wanted column and a distinct-count sketch (HyperLogLog) per wanted column. Rows of
parts combine to a summary of all by one small aggregate. Counts and extremes are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 4096    # size of a quantile sketch: about 32 KB to 100 KB stored per part and column
LG_K = 14   # distinct counts: 2^14 registers

# Published constants of the sketches' normalized errors at 99 % and two sigma.
_RANK_FACTOR, _RANK_POWER = 2.296, 0.9723
_DISTINCT_FACTOR = 1.04


def rank_error(k: int = K) -> float:
    """Rank error, as a share of the rows, that a quantile keeps with probability 0.99; merging
    sketches of one size does not widen it."""
    return _RANK_FACTOR / k**_RANK_POWER


def distinct_error(lg_k: int = LG_K, sigmas: float = 4.0) -> float:
    """Relative error of a distinct count at so many standard deviations."""
    return sigmas * _DISTINCT_FACTOR / math.sqrt(2**lg_k)


def _number(c: str) -> Column:
    """The values a quantile is over: no nulls, no NaN."""
    v = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(v), v)


def part_summaries(
    df: DataFrame, part: list[str], quantiles: list[str] = (), distinct: list[str] = (), positive: Column | None = None,
    k: int = K, lg_k: int = LG_K,
) -> DataFrame:
    """One row per part: ``n_rows``, ``n_pos``; per quantile column ``n_``, ``min_``, ``max_`` and
    ``kll_``; per distinct column ``hll_``. Partial sketches are built before the shuffle, so a part
    that holds most rows sends one row per task. Null parts are a part of their own; a column without
    values has a null sketch. Columns of other names are not read."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs.append((F.count_if(positive) if positive is not None else F.lit(None).cast("bigint")).alias("n_pos"))
    for c in quantiles:
        v = _number(c)
        n = F.count(v)
        aggs += [n.alias(f"n_{c}"), F.min(v).alias(f"min_{c}"), F.max(v).alias(f"max_{c}"), F.when(n > 0, F.kll_sketch_agg_double(v, k)).alias(f"kll_{c}")]
    for c in distinct:
        v = F.col(f"`{c}`").cast("string")
        aggs.append(F.when(F.count(v) > 0, F.hll_sketch_agg(v, lg_k)).alias(f"hll_{c}"))
    return df.groupBy(*part).agg(*aggs)


def merge_summaries(parts: DataFrame, by: list[str] = (), k: int = K) -> DataFrame:
    """The rows of ``parts`` combined per ``by`` (all of them without): the same columns. Over no
    parts at all there is one row with counts of 0 and null sketches."""
    zero = lambda c: F.coalesce(F.sum(f"`{c}`"), F.lit(0)).alias(c)
    aggs = []
    for c in parts.columns:
        q = f"`{c}`"
        if c == "n_pos":
            aggs.append(F.sum(q).alias(c))
        elif c.startswith("n_"):
            aggs.append(zero(c))
        elif c.startswith("min_"):
            aggs.append(F.min(q).alias(c))
        elif c.startswith("max_"):
            aggs.append(F.max(q).alias(c))
        elif c.startswith("kll_"):
            aggs.append(F.when(F.count(q) > 0, F.kll_merge_agg_double(q, k)).alias(c))
        elif c.startswith("hll_"):
            aggs.append(F.when(F.count(q) > 0, F.hll_union_agg(q)).alias(c))
    return parts.groupBy(*by).agg(*aggs)


def quantile_of(column: str, probs: list[float]) -> Column:
    """Array of a merged summary's quantiles; 0 and 1 are the exact extremes."""
    sketch = F.kll_sketch_get_quantile_double(F.col(f"`kll_{column}`"), F.array(*[F.lit(float(p)) for p in probs]))
    low, high = F.col(f"`min_{column}`"), F.col(f"`max_{column}`")
    return F.array(*[low if p <= 0 else high if p >= 1 else F.get(sketch, i) for i, p in enumerate(probs)])


def distinct_of(column: str) -> Column:
    """Estimated distinct values of a merged summary."""
    return F.coalesce(F.hll_sketch_estimate(F.col(f"`hll_{column}`")), F.lit(0)).cast("bigint")


def edges_from_summaries(parts: DataFrame, column: str, n_bins: int, k: int = K) -> list[float]:
    """Quantile edges of bins from stored parts, within ``rank_error(k)``; none without values."""
    probs = [i / n_bins for i in range(n_bins + 1)]
    merged = merge_summaries(parts.select(*[f"`{p}_{column}`" for p in ("n", "min", "max", "kll")]), k=k)
    row = merged.select(quantile_of(column, probs).alias("q"), F.col(f"`n_{column}`").alias("n")).first()
    return list(row["q"]) if row["n"] else []


def split_from_summaries(df: DataFrame, parts: DataFrame, time: str = "unix_ts", train_ratio: float = 0.8, val_ratio: float = 0.1, k: int = K) -> tuple[DataFrame, tuple]:
    """Train, val and test at the time quantiles of stored parts: ``df`` is not scanned for them.
    Each share is right within ``rank_error(k)``. Rows without a time are in no split."""
    merged = merge_summaries(parts.select(*[f"`{p}_{time}`" for p in ("n", "min", "max", "kll")]), k=k)
    row = merged.select(quantile_of(time, [train_ratio, train_ratio + val_ratio]).alias("q")).first()
    q1, q2 = row["q"]
    t = F.col(f"`{time}`").cast("double")
    split = F.when(t <= F.lit(q1).cast("double"), "train").when(t <= F.lit(q2).cast("double"), "val").when(t > F.lit(q2).cast("double"), "test")
    return df.where(t.isNotNull() & ~F.isnan(t)).withColumn("split", split), (q1, q2)
