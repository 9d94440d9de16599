"""Seeded training orders without sorting: a keyed permutation of row numbers.

Every epoch is a permutation of 0..n-1 that is computed, in both directions, from the row number
alone: a Feistel network over pairs (i // b, i % b) whose domain is a little larger than n; numbers
that fall outside are permuted again until they lie inside. So a row knows its slot in an epoch,
and a slot knows its row: a rank can start at any position of its endless order, and nothing is
stored but the rows with their numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import global_rank

ROUNDS = 6
# Fewer than b numbers lie outside, and a random one does with a chance below 1/b: 64 steps end every walk.
WALK = 64


def numbered(df: DataFrame, order: list[Column], name: str = "row_number", **kw) -> DataFrame:
    """Rows with their 0-based number in a total order."""
    return global_rank(df, order, name, **kw)


def _sides(n: int) -> tuple[int, int]:
    b = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return -(-max(n, 1) // b), b


def _mixed(seed: int, epoch: Column, r: Column, x: Column, size: Column, hash: str) -> Column:
    if hash == "xxhash64":
        return F.pmod(F.xxhash64(F.lit(seed), epoch, r, x), size)
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in (epoch, r, x)])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), size)


def _feistel(x: Column, n: int, epoch: Column, seed: int, back: bool, hash: str) -> Column:
    a, b = _sides(n)
    sign = -1 if back else 1

    def step(s: Column, r: Column) -> Column:
        left = F.pmod(s["l"] + sign * _mixed(seed, epoch, r, s["r"], F.lit(a), hash), F.lit(a))
        right = F.pmod(s["r"] + sign * _mixed(seed, epoch, r, s["l"], F.lit(b), hash), F.lit(b))
        even = r % 2 == 0
        return F.struct(F.when(even, left).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(right).alias("r"))

    rounds = range(ROUNDS)[::-1] if back else range(ROUNDS)
    start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))
    return F.aggregate(F.array(*[F.lit(r) for r in rounds]), start, step, lambda s: s["l"] * b + s["r"])


def _walk(x: Column, n: int, epoch: Column, seed: int, back: bool, hash: str) -> Column:
    epoch = epoch.cast("long")  # the hash depends on the type
    once = lambda v: _feistel(v, n, epoch, seed, back, hash)
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(x.cast("long")), lambda v, _: F.when(v < n, v).otherwise(once(v)))


def slot_of(number: Column, n: int, epoch: Column | int, seed: int = 42, hash: str = "xxhash64") -> Column:
    """Where row ``number`` of ``n`` stands in an epoch. ``hash="md5"`` can be reproduced elsewhere."""
    return _walk(number, n, epoch if isinstance(epoch, Column) else F.lit(epoch), seed, False, hash)


def row_of(slot: Column, n: int, epoch: Column | int, seed: int = 42, hash: str = "xxhash64") -> Column:
    """The inverse of :func:`slot_of`."""
    return _walk(slot, n, epoch if isinstance(epoch, Column) else F.lit(epoch), seed, True, hash)


def rows_of_rank(n: int, rank: int, world: int) -> int:
    """How many rows of an epoch belong to a rank: slots ``rank``, ``rank + world``, .."""
    if not 0 <= rank < world:
        raise ValueError(f"rank {rank} of {world}")
    return max(0, -(-(n - rank) // world))


def epoch_slots(df: DataFrame, n: int, epoch: Column | int, world: int, number: str = "row_number", seed: int = 42, hash: str = "xxhash64") -> DataFrame:
    """All rows with the ``rank`` they belong to in an epoch and their ``position`` there; one pass
    without a shuffle. ``df`` holds each number 0..n-1 once."""
    slot = slot_of(F.col(number), n, epoch, seed, hash)
    out = df.withColumn("_slot", slot)
    return out.withColumns({"rank": F.pmod("_slot", F.lit(world)).cast("int"), "position": F.floor(F.col("_slot") / world).cast("long")}).drop("_slot")


def order_window(spark: SparkSession, n: int, rank: int, world: int, first: int, count: int, seed: int = 42, hash: str = "xxhash64") -> DataFrame:
    """``at``, ``epoch``, ``row_number``: entries ``first`` to ``first + count - 1`` of a rank's endless order.

    Entry ``at`` lies in epoch ``at // rows_of_rank``. Nothing before the window is computed, so a run
    resumes at any position at the price of the window."""
    m = rows_of_rank(n, rank, world)
    if not m:
        raise ValueError(f"rank {rank} of {world} has none of {n} rows")
    at = spark.range(first, first + count).withColumnRenamed("id", "at").withColumn("epoch", F.floor(F.col("at") / m).cast("long"))
    return at.withColumn("row_number", row_of(F.pmod("at", F.lit(m)) * world + rank, n, F.col("epoch"), seed, hash))


def read_window(df: DataFrame, n: int, rank: int, world: int, first: int, count: int, number: str = "row_number", seed: int = 42, hash: str = "xxhash64") -> DataFrame:
    """The rows of :func:`order_window` with ``at`` and ``epoch``; a row comes once for every epoch it is in. Spark
    sends a small window to the readers and shuffles for a large one."""
    w = order_window(df.sparkSession, n, rank, world, first, count, seed, hash).withColumnRenamed("row_number", "_n")
    return df.join(w, F.col(number) == F.col("_n")).drop("_n")


def write_epoch(df: DataFrame, path: str, n: int, epoch: int, world: int, files: int = 1, number: str = "row_number", seed: int = 42, mode: str = "overwrite") -> None:
    """An epoch as ``rank=`` folders of ``files`` files each, rows in order of position; one shuffle whose
    parts are even, as slots are."""
    placed = epoch_slots(df, n, epoch, world, number, seed)
    per_file = max(1, -(-(-(-n // world)) // files))
    part = F.col("rank") * files + F.floor(F.col("position") / per_file)
    dealt = placed.withColumn("_part", part.cast("int")).repartitionByRange(world * files, "_part").sortWithinPartitions("rank", "position")
    dealt.drop("_part").write.mode(mode).partitionBy("rank").parquet(path)
