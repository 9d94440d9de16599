"""Proportionate-fair mixing: source blocks in earliest-deadline order.

A source's rows, in a seeded order, are cut into blocks of equal bytes. With share a/Q of the
slots, its block i may not start before slot floor(i Q / a) and is due by ceil((i+1) Q / a);
the earliest deadline among the released blocks takes a slot. Shares are whole numbers of Q,
so after Q slots every source has had exactly its share and the schedule repeats: one frame,
as large as the list of sources asks for, is computed once, and every block's slot follows
from its number. A source never runs a block or more ahead of or behind its share. Once a
source has run out its slots stay empty, and the others go on in proportion.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import ordered_scan
from ..session import materialize

BLOCK_BYTES = 256 << 10
FRAME = 4096       # slots of a frame at least; 16 for each source at least
ALPHA = 0.7        # default targets: a source's bytes to this power
HOT_ROWS = 200_000  # rows of one source that still count as one task's work


def shares(weights: list[float], frame: int) -> list[int]:
    """Whole shares of ``frame`` slots by largest remainders; each at least 1."""
    total = sum(weights)
    free = frame - len(weights)
    exact = [w / total * frame if total > 0 else frame / len(weights) for w in weights]
    over = [max(0.0, x - 1) for x in exact]
    scale = free / sum(over) if sum(over) > 0 else 0
    part = [x * scale if scale else free / len(weights) for x in over]
    out = [1 + int(x) for x in part]
    rest = sorted(range(len(part)), key=lambda i: (int(part[i]) - part[i], i))
    for i in rest[: frame - sum(out)]:
        out[i] += 1
    return out


def frame_schedule(share: list[int]) -> list[tuple[int, int, int]]:
    """(source, block within the frame, slot) of every slot of one frame."""
    q = sum(share)
    waiting = [(0, s, 0) for s in range(len(share))]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out = []
    for slot in range(q):
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * q // share[s]), s, i))
        due, s, i = heapq.heappop(ready)
        if slot >= due:
            raise AssertionError("a block misses its deadline")
        out.append((s, i, slot))
        if i + 1 < share[s]:
            heapq.heappush(waiting, ((i + 1) * q // share[s], s, i + 1))
    return out


def schedule(
    docs: DataFrame, weights: dict[str, float] | None = None, id: str = "doc_id", text: str = "text", source: str = "source",
    block_bytes: int = BLOCK_BYTES, alpha: float = ALPHA, seed: int = 42, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``id``, ``source``, ``text_hash``, ``n_rows``, ``n_bytes``, ``block``, ``release``, ``deadline``, ``slot``.

    One row for each different (id, source, text); ``n_rows`` counts repeats, which stay
    together. A row belongs to the block its first byte lies in; a null text has no bytes;
    a null source is a source. Without ``weights`` the target of a source is its bytes to the
    power ``alpha``; a source that ``weights`` leaves out gets the smallest share.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id).alias("id"), F.col(source).cast("string").alias("source"), F.xxhash64(text).alias("text_hash"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"),
    )
    rows = materialize(rows.groupBy("id", "source", "text_hash").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("bytes").alias("n_bytes")), "mix")
    totals = [(r["source"], r["b"]) for r in rows.groupBy("source").agg(F.sum("n_bytes").alias("b")).collect()]  # one row per source
    totals.sort(key=lambda x: (x[0] is not None, x[0]))
    if weights is None:
        wanted = [float(b) ** alpha for _, b in totals]
    else:
        wanted = [float(weights.get(s, 0.0)) for s, _ in totals]
    q = max(FRAME, 16 * len(totals))
    share = shares(wanted, q) if totals else []
    plan = spark.createDataFrame(
        [(totals[s][0], i, slot, share[s]) for s, i, slot in frame_schedule(share)] if share else [],
        "_source string, _i long, _slot long, _share long",
    )
    by_source = spark.createDataFrame([(s, a) for (s, _), a in zip(totals, share)], "_source string, _share long")
    mixed = F.xxhash64(F.lit(seed), "id", "text_hash")
    keyed = rows.withColumn("_mixed", mixed)
    order = [F.col("_mixed"), F.col("id"), F.col("text_hash")]
    scanned = ordered_scan(keyed, ["source"], order, sums={"_through": "n_bytes"}, hot_rows=hot_rows)
    # As many rows as sources.
    blocks = scanned.join(F.broadcast(by_source), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    block = F.floor((F.col("_through") - F.col("n_bytes")) / F.lit(block_bytes))
    blocks = blocks.withColumn("block", block).withColumn("_at", F.col("block") % F.col("_share"))
    # The frame: 16 rows for each source, or FRAME rows.
    placed = blocks.join(F.broadcast(plan.drop("_share")), F.col("source").eqNullSafe(F.col("_source")) & (F.col("_at") == F.col("_i")))
    frame = F.floor(F.col("block") / F.col("_share")) * q
    turn = lambda n: n * F.lit(q) / F.col("_share")
    return placed.select(
        F.col("id").alias(id), "source", "text_hash", "n_rows", "n_bytes", "block",
        (frame + F.floor(turn(F.col("_at")))).alias("release"), (frame + F.ceil(turn(F.col("_at") + 1))).alias("deadline"), (frame + F.col("_slot")).alias("slot"),
        "_mixed",
    )


def mix_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **kw) -> DataFrame:
    """Every row of ``docs`` once, in slot order: rows are dealt out and sorted by slot, so
    files written from the result lie in training order."""
    plan = schedule(docs, id=id, text=text, source=source, **kw)
    plan = plan.select(F.col(id).alias("_id"), F.col("source").alias("_src"), "text_hash", "slot", "_mixed")
    same = F.col(id).eqNullSafe(F.col("_id")) & F.col(source).cast("string").eqNullSafe(F.col("_src")) & (F.xxhash64(text) == F.col("text_hash"))
    joined = docs.join(plan, same)
    dealt = joined.repartitionByRange("slot", "_mixed").sortWithinPartitions("slot", "_mixed")
    return dealt.select(*[F.col(f"`{c}`") for c in docs.columns])
