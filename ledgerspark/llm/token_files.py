"""Token ids of all documents in files of blocks, with Elias-Fano document boundaries.

A file is a Parquet file written by Spark's committer, so it may lie in any store and
survives lost executors. One row is a block: the ids of consecutive documents end to end,
two bytes each where the vocabulary allows it, and the documents' ends inside the block
as an Elias-Fano sequence. ``part`` and ``block`` give the blocks' order; ``before`` counts
the ids of the same part's earlier blocks. No 64-bit offset table is kept.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .elias_fano import EliasFano, encode
from .pieces_bpe import encoder
from .texts import strings

BLOCK_IDS = 1 << 21  # ids after which a block ends; a document is never cut
END_ID = 2


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, id: str = "doc_id", text: str = "text",
    order: list[Column] | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS,
) -> None:
    """Write the ids of every whole text, followed by ``end_id``.

    Documents lie in rising order of ``id`` (nulls first, equal ids by text), or of
    ``order`` (rising). A null text is empty: it has the end id alone. Rows are dealt out by ranges
    of the order and the text's hash, so that a repeated id does not fill one task.
    """
    id_type = docs.schema[id].dataType
    order = order or [F.col(id)]
    keyed = docs.select(id, text, *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    keys = [F.col(f"_o{i}").asc_nulls_first() for i in range(len(order))]
    dealt = keyed.repartitionByRange(*keys, F.xxhash64(text)).sortWithinPartitions(*keys, F.xxhash64(text), F.col(text))

    def run(batches):
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        state = {"block": 0, "before": 0, "size": 0, "ids": [], "ends": [], "names": []}

        def flush():
            ids = np.frombuffer(b"".join(state["ids"]), "<u4")
            width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
            row = [
                pa.array([part], pa.int32()), pa.array([state["block"]], pa.int32()), pa.array([state["before"]], pa.int64()),
                pa.array([len(ids)], pa.int64()), pa.array([width], pa.int32()),
                pa.ListArray.from_arrays(pa.array([0, len(state["ends"])], pa.int32()), pa.concat_arrays(state["names"])),
                pa.array([encode(state["ends"])], pa.binary()), pa.array([ids.astype(f"<u{width}").tobytes()], pa.binary()),
            ]
            state.update(block=state["block"] + 1, before=state["before"] + len(ids), size=0, ids=[], ends=[], names=[])
            return pa.RecordBatch.from_arrays(row, ["part", "block", "before", "n_ids", "width", "names", "ends", "ids"])

        for batch in batches:
            names = batch.column(0)
            for lo, hi, texts in strings(batch.column(1)):
                for i, t in enumerate(texts, lo):
                    ids = enc.encode(t) + end
                    state["size"] += len(ids) // 4
                    state["ids"].append(ids)
                    state["ends"].append(state["size"])
                    state["names"].append(names.slice(i, 1))
                    if state["size"] >= block_ids:
                        yield flush()
        if state["ends"]:
            yield flush()

    schema = f"part int, block int, before long, n_ids long, width int, names array<{id_type.simpleString()}>, ends binary, ids binary"
    dealt.select(id, text).mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str, id: str = "doc_id") -> DataFrame:
    """``id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``, from
    the files alone. ``ids_crc32`` is that of the ids as little-endian 32-bit values."""
    blocks = spark.read.parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    # One row per task that wrote.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    joined = blocks.join(F.broadcast(starts), F.col("part") == F.col("_part"))
    id_type = blocks.schema["names"].dataType.elementType

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                start, width, names, ends, data = (batch.column(k).slice(r, 1) for k in range(5))
                last = EliasFano(ends[0].as_py()).all()
                first = np.concatenate([[0], last[:-1]])
                body = memoryview(np.frombuffer(data[0].as_buffer(), f"<u{width[0].as_py()}").astype("<u4")).cast("B")
                crc = [zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(first.tolist(), last.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [names.flatten(), pa.array(first + start[0].as_py()), pa.array(last - first), pa.array(crc, pa.int64())],
                    [id, "start", "n_tokens", "ids_crc32"],
                )

    columns = joined.select((F.col("_start") + F.col("before")).alias("start"), "width", "names", "ends", "ids")
    return columns.mapInArrow(run, f"`{id}` {id_type.simpleString()}, start long, n_tokens long, ids_crc32 long")


def document_ids(block, i: int) -> np.ndarray:
    """The ids of document ``i`` of a block row, found by two selects."""
    ends = EliasFano(bytes(block["ends"]))
    lo, hi = ends.select(i - 1) if i else 0, ends.select(i)
    return np.frombuffer(bytes(block["ids"]), f"<u{block['width']}")[lo:hi].astype(np.uint32)
