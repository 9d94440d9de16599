"""Substring deduplication by content-defined chunks.

A gear hash rolls over the last 32 bytes; a chunk ends where its top bits are 0, so chunk
borders move with the content and an insertion changes the chunks around it alone. Chunks
are deduplicated by digest: of equal chunks the first place, by document and position, stays.
Runs of repeated chunks that are too short to be a passage are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .texts import pieces

GEAR = np.random.default_rng(20160622).integers(0, 2**32, 256, dtype=np.uint32)
WINDOW = 32      # bytes that decide about a border
CUT_BITS = 4     # a border about every 16 bytes after the least size
LEAST, MOST = 16, 256
LEAST_RUN = 80   # bytes of repeated chunks in a row that make a passage


def gear_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the last 32 gear values of the text, each shifted by its distance, by doubling the reach."""
    h, reach = GEAR[data], 1
    while reach < WINDOW:
        ahead = h.copy()
        ahead[reach:] += h[:-reach] << np.uint32(reach)
        h, reach = ahead, reach * 2
    # The first bytes of a text do not see the text before it.
    start, stop, own = offsets[:-1], offsets[1:], np.zeros(len(offsets) - 1, np.uint32)
    for k in range(WINDOW - 1):
        on = start + k < stop
        start, stop = start[on], stop[on]
        own = (own[on] << np.uint32(1)) + GEAR[data[start + k]]
        h[start + k] = own
    return h


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, end) of the chunks of every text; an empty text has none."""
    cand = np.flatnonzero((gear_hashes(data, offsets) >> np.uint32(32 - CUT_BITS)) == 0) + 1
    at = np.searchsorted(cand, offsets)
    ends: list[int] = []
    count = np.zeros(len(offsets) - 1, np.int64)
    listed = cand.tolist()
    for i in range(len(offsets) - 1):
        last, stop, n = int(offsets[i]), int(offsets[i + 1]), len(ends)
        for c in listed[at[i] : at[i + 1]]:
            if c - last < LEAST:
                continue
            while c - last > MOST:
                last += MOST
                ends.append(last)
            if c - last >= LEAST:
                ends.append(c)
                last = c
        while stop - last > MOST:
            last += MOST
            ends.append(last)
        if stop > last:
            ends.append(stop)
        count[i] = len(ends) - n
    return np.repeat(np.arange(len(count)), count), np.array(ends, np.int64)


def chunked(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``h`` (hash of the text), ``start``, ``n``, ``counts``, ``d1``, ``d2``: one row per chunk; an
    empty text has one of no bytes. ``counts`` is false for a tail below the least size: it ends
    with its text, not with its content, and is never taken for repeated."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column(2)):
                doc, end = chunk_ends(data, offsets)
                new = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
                start = np.concatenate([[0], end[:-1]]) if len(doc) else end
                start[new] = offsets[doc[new]]
                body = data.tobytes()
                digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(body[a:b]) for a, b in zip(start.tolist(), end.tolist())]), "<i8").reshape(-1, 2)
                whole = (start == offsets[doc]) & (end == offsets[doc + 1])
                empty = np.flatnonzero(np.diff(offsets) == 0)
                pick = np.concatenate([doc, empty])
                none = np.zeros(len(empty), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(k).slice(lo, hi - lo).take(pa.array(pick)) for k in (0, 1)],
                        pa.array(np.concatenate([start - offsets[doc], none])), pa.array(np.concatenate([end - start, none]).astype(np.int32)),
                        pa.array(np.concatenate([(end - start >= LEAST) | whole, none > 0])),
                        pa.array(np.concatenate([digest[:, 0], none])), pa.array(np.concatenate([digest[:, 1], none])),
                    ],
                    ["doc", "h", "start", "n", "counts", "d1", "d2"],
                )

    slim = docs.select(F.col(id).alias("doc"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    id_type = docs.schema[id].dataType.simpleString()
    return slim.mapInArrow(run, f"doc {id_type}, h long, start long, n int, counts boolean, d1 long, d2 long")


def remove_repeated_chunks(docs: DataFrame, id: str = "doc_id", text: str = "text", least_run: int = LEAST_RUN) -> DataFrame:
    """``id``, ``n_bytes``, ``n_chunks``, ``n_repeated`` (bytes in passages found elsewhere too), ``n_removed``
    (bytes of them that are not the first), ``removed`` (first, end of each removed stretch).

    One row per row of ``docs``. A null text is empty. Passages are runs of repeated chunks of at
    least ``least_run`` bytes, or whole texts. Rows with the same id and text are one place: their
    chunks count as repeated but none of them is removed for the other.
    """
    chunks = materialize(chunked(docs, id, text), "chunks")
    of_text = chunks.groupBy("doc", "h").agg(F.count_if(F.expr("start = 0")).alias("rows"), F.sum("n").alias("bytes"), F.count_if(F.expr("n > 0")).alias("chunks"))
    groups = chunks.where("counts").groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc", "h", "start")).alias("first"))
    # Stored, so that both sides of the join are plain shuffles, whose large keys Spark can split.
    groups = materialize(groups.where("c > 1").select(F.col("d1").alias("_1"), F.col("d2").alias("_2"), "first"), "groups")
    here = F.struct("doc", "h", "start")
    hit = chunks.where("counts").join(groups, (F.col("d1") == F.col("_1")) & (F.col("d2") == F.col("_2")))
    hit = hit.select("doc", "h", F.struct("start", "n", (here != F.col("first")).alias("later")).alias("part"))
    lists = hit.groupBy("doc", "h").agg(F.array_sort(F.collect_set("part")).alias("parts"))
    joined = of_text.join(lists.withColumnsRenamed({"doc": "_doc", "h": "_h"}), (F.col("h") == F.col("_h")) & F.col("doc").eqNullSafe(F.col("_doc")), "left")

    def run(batches):
        for batch in batches:
            out = []
            for rows, size, parts in zip(*[batch.column(k).to_pylist() for k in (1, 2, 4)]):
                size = size // max(rows, 1)
                runs: list[list] = []
                for p in parts or []:
                    a, b = p["start"], p["start"] + p["n"]
                    if not runs or runs[-1][-1][1] != a:
                        runs.append([])
                    runs[-1].append((a, b, p["later"]))
                runs = [r for r in runs if r[-1][1] - r[0][0] >= min(least_run, size)]
                gone: list[list[int]] = []
                for a, b, later in (x for r in runs for x in r):
                    if later and gone and gone[-1][1] == a:
                        gone[-1][1] = b
                    elif later:
                        gone.append([a, b])
                out.append((size, sum(r[-1][1] - r[0][0] for r in runs), sum(b - a for a, b in gone), [{"first": a, "end": b} for a, b in gone]))
            size, repeated, removed, spans = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(x, pa.int64()) for x in (size,)], batch.column(3), *[pa.array(x, pa.int64()) for x in (repeated, removed)], pa.array(spans, span)],
                [id, "rows", "n_bytes", "n_chunks", "n_repeated", "n_removed", "removed"],
            )

    span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    id_type = docs.schema[id].dataType.simpleString()
    out = joined.select("doc", "rows", "bytes", "chunks", "parts").mapInArrow(
        run, f"`{id}` {id_type}, rows long, n_bytes long, n_chunks long, n_repeated long, n_removed long, removed array<struct<first: long, end: long>>"
    )
    copies = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return copies.select(id, "n_bytes", F.floor(F.col("n_chunks") / F.col("rows")).alias("n_chunks"), "n_repeated", "n_removed", "removed")
