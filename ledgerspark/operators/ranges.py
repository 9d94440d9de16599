"""Range tables of any size: overlapping ranges made disjoint, values looked up by equality.

A stretch of whole numbers is cut into dyadic blocks, numbers that agree but for their last k bits:
at most two per level. A number lies in one block per level. So "which ranges hold this number"
becomes an equality join on (level, block), whatever the ranges look like, and no range is exploded
by its width. Overlaps are settled the same way, with the places of the ranges' ends as numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ordered import HOT_ROWS, global_rank

LEVELS = 63
LIMIT = 1 << 62  # numbers of a larger size have no range


def dyadic_blocks(lo: Column, hi: Column) -> Column:
    """Array of (level, block) that make up ``lo`` to ``hi``, both included; empty if ``hi < lo``."""

    def at(k: Column) -> Column:
        # Smallest block that starts at or above lo, and the one behind the last that ends at or below hi.
        first, end = -F.call_function("shiftright", -lo, k), F.call_function("shiftright", hi + 1, k)
        takes_first = (F.abs(first % 2) == 1) & (first < end)
        takes_last = (F.abs(end % 2) == 1) & (first + takes_first.cast("int") < end)
        one = lambda b: F.struct(k.cast("int").alias("level"), b.alias("block"))
        return F.filter(F.array(F.when(takes_first, one(first)), F.when(takes_last, one(end - 1))), lambda x: x.isNotNull())

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), at))


def _levels(blocks: DataFrame) -> list[int]:
    return sorted(r["level"] for r in blocks.select("level").distinct().collect())  # at most LEVELS


def _blocks_of(number: Column, levels: list[int]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(number, k).alias("block")) for k in levels]))


def flatten_ranges(ranges: DataFrame, lo: str = "lo", hi: str = "hi", label: str = "label", order: str = "seq", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Disjoint ``lo``, ``hi``, ``label`` in which every number has the label of the last range (by ``order``) that
    holds it. Neighbouring pieces of one range are not joined.

    Among equal ``order`` the largest label wins. Ranges without an end or order, and those whose end
    lies before their start, hold nothing; ends beyond 2^62 are drawn in.
    """
    whole = lambda c: F.greatest(F.least(F.col(c).cast("long"), F.lit(LIMIT - 1)), F.lit(1 - LIMIT))
    given = ranges.where(F.col(lo).isNotNull() & F.col(hi).isNotNull() & F.col(order).isNotNull() & (F.col(hi) >= F.col(lo)))
    given = given.where((F.col(lo) < LIMIT) & (F.col(hi) > -LIMIT))
    given = materialize(given.select(whole(lo).alias("lo"), whole(hi).alias("hi"), F.struct(F.col(order).alias("o"), F.col(label).cast("string").alias("label")).alias("last")), "ranges")
    ends = given.select(F.explode(F.array("lo", F.col("hi") + 1)).alias("at")).distinct()
    places = materialize(global_rank(ends, [F.col("at")], "i", hot_rows=hot_rows), "ends")
    first, end = places.select(F.col("at").alias("lo"), F.col("i").alias("a")), places.select((F.col("at") - 1).alias("hi"), F.col("i").alias("z"))
    pieces = given.join(first, "lo").join(end, "hi").select(F.explode(dyadic_blocks(F.col("a"), F.col("z") - 1)).alias("d"), "last")
    cover = materialize(pieces.groupBy("d.level", "d.block").agg(F.max("last").alias("last")), "cover")
    levels = _levels(cover)
    if not levels:
        return given.select("lo", "hi", F.col("last.label").alias("label")).limit(0)
    # A piece reaches from its end to the next one.
    after = places.select((F.col("i") - 1).alias("i"), (F.col("at") - 1).alias("hi"))
    each = places.join(after, "i").select(F.col("at").alias("lo"), "hi", _blocks_of(F.col("i"), levels).alias("d")).select("lo", "hi", "d.*")
    held = each.join(cover, ["level", "block"]).groupBy("lo", "hi").agg(F.max("last").alias("last"))
    return held.select("lo", "hi", F.col("last.label").alias("label"))


def lookup_ranges(df: DataFrame, column: str, flat: DataFrame, name: str = "label", default: str | None = None) -> DataFrame:
    """``df`` with the label of the range that holds ``column`` (``default`` for none, and for a null).

    ``flat`` holds disjoint ``lo``, ``hi``, ``label``. Each different value is looked up once, so a very frequent
    one costs a row; the values then go back to the rows by an equality join with a unique side.
    """
    blocks = flat.select(F.explode(dyadic_blocks(F.col("lo"), F.col("hi"))).alias("d"), F.col("label").alias("_found")).select("d.*", "_found")
    blocks = materialize(blocks, "blocks")
    levels = _levels(blocks)
    if not levels:
        return df.withColumn(name, F.lit(default).cast("string"))
    value = F.col(f"`{column}`").cast("long")
    values = df.select(value.alias("_v")).where((F.col("_v") > -LIMIT) & (F.col("_v") < LIMIT)).distinct()
    found = values.select("_v", _blocks_of(F.col("_v"), levels).alias("d")).select("_v", "d.*").join(blocks, ["level", "block"]).select("_v", "_found")
    return df.join(found, value == F.col("_v"), "left").withColumn(name, F.coalesce("_found", F.lit(default).cast("string"))).drop("_v", *(["_found"] if name != "_found" else []))
