"""Batches padded to their own length, under a budget of padded steps.

Samples are taken in classes of similar length. Inside a class the place of a sample in a seeded
order says its batch, so a batch is filled before the next begins, and only the last one of a
class is short. Places come from ordered scans, which split a class that holds most samples.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import HOT_ROWS, ordered_scan

GROWTH = 1.125  # a class's longest sample over its shortest, about


def widths(longest: int, growth: float = GROWTH) -> list[int]:
    """Upper lengths of the classes, rising to ``longest``."""
    out = [1]
    while out[-1] < longest:
        out.append(min(longest, max(out[-1] + 1, math.floor(out[-1] * growth))))
    return out


def seeded_key(id: Column, seed: int, epoch: int, hash: str = "xxhash64") -> Column:
    """Order of an epoch; md5 keys can be made again by other engines."""
    if hash == "md5":
        return F.md5(F.concat(F.lit(f"{seed}:{epoch}:"), id.cast("string")))
    return F.xxhash64(F.lit(seed), F.lit(epoch), id)


def assign_batches(
    samples: DataFrame, id: str, length: str, budget: int, longest: int, seed: int = 42, epoch: int = 0, growth: float = GROWTH,
    hash: str = "xxhash64", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``samples`` with ``width`` (upper length of the class), ``batch`` (number in the class),
    ``place`` (in the batch) and ``batch_key`` (read batches in its order).

    Every sample is in exactly one batch; rows times width stay within ``budget``. A length above
    ``longest`` counts as ``longest`` (its sample will be cut); one of 0 or null as 1. ``budget`` must
    hold one sample of the longest class. Equal ids are ordered by nothing else and may change places.
    """
    if budget < longest:
        raise ValueError(f"a budget of {budget} does not hold one sample of {longest}")
    upper = widths(longest, growth)
    n = F.least(F.greatest(F.coalesce(F.col(f"`{length}`").cast("int"), F.lit(1)), F.lit(1)), F.lit(longest))
    listed = F.array(*[F.lit(w) for w in upper])
    width = F.element_at(F.filter(listed, lambda w: w >= n), 1)
    key = seeded_key(F.col(f"`{id}`"), seed, epoch, hash)
    out = ordered_scan(samples.withColumn("width", width), ["width"], [key, F.col(f"`{id}`")], position="_pos", hot_rows=hot_rows)
    rows = F.floor(F.lit(budget) / F.col("width")).cast("bigint")
    out = out.withColumns({"batch": F.floor(F.col("_pos") / rows).cast("bigint"), "place": (F.col("_pos") % rows).cast("int")}).drop("_pos")
    return out.withColumn("batch_key", seeded_key(F.concat_ws(":", "width", "batch"), seed, epoch, hash))


def gather_batches(assigned: DataFrame, columns: list[str], length: str = "lens_in") -> DataFrame:
    """One row per batch: ``n``, ``pad_to`` (its longest sample) and ``rows``, samples by place. A row
    holds at most the budget's steps."""
    packed = F.struct("place", *[F.col(f"`{c}`") for c in columns])
    return assigned.groupBy("batch_key", "width", "batch").agg(
        F.count(F.lit(1)).alias("n"), F.least(F.max(F.greatest(F.coalesce(F.col(f"`{length}`"), F.lit(1)), F.lit(1))), F.max("width")).cast("int").alias("pad_to"),
        F.sort_array(F.collect_list(packed)).alias("rows"),
    )


def pad_batches(batches: DataFrame, txn_len: int) -> DataFrame:
    """The gathered samples of ``sft_samples`` made rectangular inside their batch: as
    ``pad_history`` does, but to ``pad_to`` instead of one length for all."""
    from ..functions.constants import PAD

    def padded(r, name, zero):
        x = F.slice(r[name], 1, F.col("pad_to"))
        return F.concat(x, F.array_repeat(zero, F.col("pad_to") - F.size(x)))

    zero_ids, zero_long = F.array_repeat(F.lit(PAD), txn_len), F.lit(0).cast("bigint")
    zero_mask = F.array_repeat(F.lit(0), txn_len)
    def sample(r):
        n = F.least(F.size(r["input_ids"]), F.col("pad_to"))
        return F.struct(
            padded(r, "input_ids", zero_ids).alias("input_ids"), padded(r, "attention_mask", zero_mask).alias("attention_mask"),
            F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.col("pad_to") - n)).alias("step_mask"),
            padded(r, "his_time_stap", zero_long).alias("his_time_stap"), padded(r, "delta_time_stap", zero_long).alias("delta_time_stap"),
            r["user_id"].alias("user_id"), r["label"].alias("label"), r["amount"].alias("amount"), n.alias("lens_in"),
        )

    return batches.withColumn("rows", F.transform("rows", sample))


def padding_share(assigned: DataFrame, length: str, fixed: int) -> DataFrame:
    """``n_samples``, ``n_batches``, and the shares of padded steps: ``share`` of these batches,
    ``fixed_share`` of samples all padded to ``fixed``."""
    n = F.least(F.greatest(F.coalesce(F.col(f"`{length}`"), F.lit(1)), F.lit(1)), F.lit(fixed))
    each = assigned.groupBy("width", "batch").agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("steps"), F.max(n).alias("pad_to"))
    used, held = F.sum("steps"), F.sum(F.col("k") * F.col("pad_to"))
    return each.agg(
        F.sum("k").alias("n_samples"), F.count(F.lit(1)).alias("n_batches"), F.try_divide(held - used, held).alias("share"),
        (1 - F.try_divide(used, F.sum("k") * fixed)).alias("fixed_share"),
    )
