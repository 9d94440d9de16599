"""Removal of long byte strings that occur more than once, with suffix arrays.

Every string of the given length belongs to the stretch of its least 16-byte gram, so equal
strings, wherever they stand, lie in stretches with the same gram (their anchor). Stretches
whose anchor stands once in the whole corpus hold no repeated string and are left there. Of
the others, equal ones are counted together by a digest of their bytes. A string reaches at
least half of its other bytes to the left of its anchor or to the right, so two different
stretches share one only if they agree on a whole side; those that agree with another meet, with
all such stretches of their anchor, in one shard, half a megabyte of text, which gets a suffix array
by induced sorting and its permuted common prefixes: a string is repeated where a prefix shared
with a neighbour is as long as the string, or where its whole stretch occurs again. An anchor with very many different
stretches would fill a task; its strings are counted by their digests instead, which combine
before the shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .suffix_sort import permuted_prefixes, suffix_array
from .texts import pieces
from .words import mix, running_sum

LENGTH = 400
GRAM = 16
SEGMENT = 8 << 20       # a longer text is taken in segments that overlap by one string
SHARD_BYTES = 512 << 10  # text of one suffix array
HOT_STRETCHES = 20_000  # different stretches of an anchor above which strings are counted by digest

_VALUE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE_BITS = 24


def _window_least(v: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours: running minima to both sides of block edges."""
    n = len(v) - width + 1
    blocks = -(-len(v) // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(v)] = v
    ahead = np.minimum.accumulate(full.reshape(blocks, width), 1).ravel()
    back = np.minimum.accumulate(full.reshape(blocks, width)[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _side(sums, down, lo, hi, first, end) -> np.ndarray:
    """Hash of bytes lo..hi-1; 0 where they reach beyond the stretch. Equal bytes have equal
    hashes; others may, which costs a comparison and changes no result."""
    inside = (lo >= first) & (hi <= end)
    lo, hi = np.where(inside, lo, 0), np.where(inside, hi, 0)
    return np.where(inside, mix((sums[hi] - sums[lo]) * down[lo]) | np.uint64(1), np.uint64(0))


def stretches(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text number, first start, number of starts, anchor, left side, right side) of every stretch."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 3
    if len(data) < length:
        return none
    if len(data) > SEGMENT + length:
        out = []
        for lo in range(0, len(data), SEGMENT):
            hi = min(len(data), lo + SEGMENT + length - 1)
            doc, start, *rest = stretches(data[lo:hi], np.clip(offsets, lo, hi) - lo, length)
            shift = np.maximum(lo - offsets[:-1], 0)[doc] if len(doc) else 0
            out.append((doc, start + shift, *rest))
        return tuple(np.concatenate(x) for x in zip(*out))
    sums, down = running_sum(_VALUE[data])
    gram_at = np.arange(len(data) - GRAM + 1)
    gram = mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(gram_at)])
    keyed = (gram >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | gram_at.astype(np.uint64)
    least = (_window_least(keyed, length - GRAM + 1) & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    size = np.diff(offsets)
    good = np.zeros(len(least) + 1, bool)  # starts whose string lies in one text
    for a, n in zip(offsets[:-1][size >= length].tolist(), size[size >= length].tolist()):
        good[a : a + n - length + 1] = True
    good = good[:-1]
    first = good.copy()
    first[1:] &= ~good[:-1] | (least[1:] != least[:-1])
    starts_text = offsets[:-1][size >= length]
    first[starts_text] = True
    start = np.flatnonzero(first)
    last = good.copy()
    last[:-1] &= ~good[1:] | first[1:]
    n = np.flatnonzero(last) + 1 - start
    doc = np.searchsorted(offsets, start, "right") - 1
    # A string's bytes beside its anchor: on one side of it lie at least half of them.
    place, end, reach = least[start], start + n + length - 1, (length - GRAM + 1) // 2
    left = _side(sums, down, place - reach, place + GRAM, start, end)
    right = _side(sums, down, place, place + GRAM + reach, start, end)
    return doc, start - offsets[doc], n, gram[place], left, right


def _found(docs: DataFrame, id: str, text: str, length: int) -> DataFrame:
    """``doc``, ``h`` (hash of the text), ``start``, ``n``, ``anchor``, ``digest`` (128 bits, of its
    bytes), ``left``, ``right`` of every stretch."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column(2)):
                doc, start, n, anchor, left, right = stretches(data, offsets, length)
                pick, whole = pa.array(doc), memoryview(data)
                at = offsets[doc] + start
                digest = [hashlib.blake2b(whole[a:b], digest_size=16).digest() for a, b in zip(at.tolist(), (at + n + length - 1).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(k).slice(lo, hi - lo).take(pick) for k in (0, 1)], pa.array(start, pa.int64()), pa.array(n.astype(np.int32)),
                        pa.array(anchor.view(np.int64)), pa.array(digest, pa.binary()), pa.array(left.view(np.int64)), pa.array(right.view(np.int64)),
                    ],
                    ["doc", "h", "start", "n", "anchor", "digest", "left", "right"],
                )

    id_type = docs.schema[id].dataType.simpleString()
    slim = docs.select(F.col(id).alias("doc"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    return slim.mapInArrow(run, f"doc {id_type}, h long, start long, n int, anchor long, digest binary, left long, right long")


def _with_lists(docs: DataFrame, lists: DataFrame, id: str, text: str, how: str) -> DataFrame:
    """``doc``, ``h``, ``text`` and the lists of ``lists``: they grow with the texts, so both are
    dealt out by the texts' hash."""
    slim = docs.select(F.col(id).alias("doc"), F.xxhash64(text).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    side = lists.withColumnsRenamed({"doc": "_doc", "h": "_h"})
    return slim.join(side, (F.col("h") == F.col("_h")) & F.col("doc").eqNullSafe(F.col("_doc")), how).drop("_doc", "_h")


def _meeting(different: DataFrame) -> DataFrame:
    """``different`` with ``meets``: another stretch has a side of the stretch, so that the two
    may share a string. The joins are by sides that stand more than once and by (anchor, digest),
    which stands once; sides beyond the stretch (0) would share one key and take no part."""
    side = lambda k, c: F.struct(F.lit(k).alias("k"), F.col(c).alias("s"))
    sides = different.select("anchor", "digest", F.explode(F.array(side("l", "left"), side("r", "right"))).alias("x"))
    # Stored, so that a very frequent side is split by the join.
    sides = materialize(sides.select("anchor", "digest", "x.*").where("s <> 0"), "sides")
    often = materialize(sides.groupBy("k", "s").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("k").alias("_k"), F.col("s").alias("_s")), "often")
    met = sides.join(often, (F.col("k") == F.col("_k")) & (F.col("s") == F.col("_s"))).select(F.col("anchor").alias("_a"), F.col("digest").alias("_d")).distinct()
    out = different.join(met, (F.col("anchor") == F.col("_a")) & (F.col("digest") == F.col("_d")), "left")
    return out.withColumn("meets", F.col("_a").isNotNull()).drop("_a", "_d", "left", "right")


def _texts(docs: DataFrame, wanted: DataFrame, id: str, text: str, length: int) -> DataFrame:
    """``anchor``, ``digest``, ``w``, ``n`` and the bytes of every wanted stretch."""
    lists = wanted.groupBy("doc", "h").agg(F.collect_list(F.struct("anchor", "digest", "w", "start", "n")).alias("parts"))
    joined = _with_lists(docs, lists, id, text, "inner")
    # Rows with the same id and text are one place, so a part may come from several rows.
    joined = joined.select("text", "parts")

    def run(batches):
        for batch in batches:
            for text_, parts in zip(batch.column(0), batch.column(1)):
                data = memoryview(text_.as_buffer())
                p = parts.values.flatten()
                start, n = p[3].to_numpy(), p[4].to_numpy()
                cut = [bytes(data[a : a + k + length - 1]) for a, k in zip(start.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([p[0], p[1], p[2], p[4], pa.array(cut, pa.binary())], ["anchor", "digest", "w", "n", "bytes"])

    return joined.mapInArrow(run, "anchor long, digest binary, w long, n int, bytes binary")


def repeated_starts(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Starts in each text whose string of ``length`` bytes starts elsewhere in the shard too."""
    size = np.array([len(t) for t in texts])
    at = np.cumsum(size + 1) - size - 1
    # A text ends with symbol 1, the shard with 0; bytes follow from 2 on.
    s = np.zeros(int(size.sum()) + len(texts) + 1, np.int16)
    s[:-1] = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int16) + 2
    s[at + size] = 1
    sa = suffix_array(s)
    shared = permuted_prefixes(s, sa)[sa] >= length
    again = np.zeros(len(s), bool)
    again[sa[shared]] = True
    again[sa[:-1][shared[1:]]] = True
    return [np.flatnonzero(again[a : a + max(0, n - length + 1)]) for a, n in zip(at.tolist(), size.tolist())]


def _runs(x: np.ndarray) -> list[dict]:
    """Neighbouring numbers as (first, how many)."""
    if not len(x):
        return []
    cut = np.flatnonzero(np.diff(x) != 1)
    a, b = x[np.concatenate([[0], cut + 1])], x[np.concatenate([cut, [len(x) - 1]])]
    return [{"start": int(p), "n": int(q - p + 1)} for p, q in zip(a, b)]


_RUN = pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())]))


def _by_array(texts: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """``anchor``, ``digest``, ``runs``: repeated starts of each stretch, by suffix arrays."""

    def solve(held):
        again = repeated_starts([t for _, _, _, _, t in held], length)
        rows = [(a, d, _runs(np.arange(n) if w > 1 else x)) for (a, d, w, n, _), x in zip(held, again)]
        rows = [r for r in rows if r[2]]
        cols = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), _RUN))], ["anchor", "digest", "runs"])

    def run(batches):
        held, size, now = [], 0, None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if size >= shard_bytes and row[0] != now:
                    yield solve(held)
                    held, size = [], 0
                now = row[0]
                if not held or held[-1][:2] != row[:2]:
                    held.append(row)
                    size += len(row[4])
        if held:
            yield solve(held)

    dealt = texts.repartition("anchor").sortWithinPartitions("anchor", "digest")
    return dealt.mapInArrow(run, "anchor long, digest binary, runs array<struct<start: long, n: long>>")


def _by_digest(texts: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many stretches: strings are counted by a 128-bit digest."""

    def run(batches):
        for batch in batches:
            for a, d, w, n, t in zip(*[c.to_pylist() for c in batch.columns]):
                keys = [hashlib.blake2b(t[i : i + length], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([a] * n), pa.array([d] * n), pa.array([w] * n), pa.array(range(n), pa.int64()), pa.array(keys)], ["anchor", "digest", "w", "i", "key"])

    each = materialize(texts.select("anchor", "digest", "w", "n", "bytes").mapInArrow(run, "anchor long, digest binary, w long, i long, key binary"), "strings")
    again = each.groupBy("key").agg(F.sum("w").alias("_w")).where("_w > 1").select(F.col("key").alias("_key"))
    hit = each.join(again, F.col("key") == F.col("_key"))
    return hit.groupBy("anchor", "digest").agg(F.collect_list(F.struct(F.col("i").alias("start"), F.lit(1).cast("long").alias("n"))).alias("runs"))


def repeated_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH,
                   shard_bytes: int = SHARD_BYTES, hot: int = HOT_STRETCHES) -> DataFrame:
    """``doc``, ``h``, ``runs`` (start, n): the starts of repeated strings, for texts that have any.

    ``h`` is the text's hash; rows with the same id and text share a row here.
    """
    found = materialize(_found(docs, id, text, length), "stretches")
    # Stored, so that both sides of the join are plain shuffles, whose large keys Spark can split.
    anchors = materialize(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("anchor").alias("_a")), "anchors")
    shared = materialize(found.join(anchors, F.col("anchor") == F.col("_a")).select(*found.columns), "shared")
    place = F.min(F.struct("doc", "h", "start", "n", "left", "right")).alias("p")
    different = materialize(shared.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("w"), place).select("anchor", "digest", "w", "p.*"), "different")
    meeting = materialize(_meeting(different), "meeting")
    per_anchor = materialize(meeting.where("meets").groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).select(F.col("anchor").alias("_a"), "k"), "counts")
    texts = _texts(docs, meeting.where("meets").drop("meets"), id, text, length)
    busy = per_anchor.where(F.col("k") > hot).select("_a")
    if busy.isEmpty():
        solved = _by_array(texts, length, shard_bytes)
    else:
        texts = materialize(texts, "texts")
        solved = _by_array(texts.join(busy, F.col("anchor") == F.col("_a"), "left_anti"), length, shard_bytes)
        solved = solved.union(_by_digest(texts.join(busy, F.col("anchor") == F.col("_a"), "left_semi").dropDuplicates(["anchor", "digest"]), length))
    # A stretch that occurs again and meets no other is repeated whole.
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("n")))
    solved = solved.unionByName(meeting.where("w > 1 AND NOT meets").select("anchor", "digest", all_of_it.alias("runs")))
    solved = solved.withColumnsRenamed({"anchor": "_a", "digest": "_d"})
    back = shared.join(solved, (F.col("anchor") == F.col("_a")) & (F.col("digest") == F.col("_d")))
    moved = F.transform("runs", lambda r: F.struct((r["start"] + F.col("start")).alias("start"), r["n"].alias("n")))
    return back.select("doc", "h", F.explode(moved).alias("r")).distinct().groupBy("doc", "h").agg(F.collect_list("r").alias("runs"))


def remove_repeated(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, keep_text: bool = False, **kw) -> DataFrame:
    """``id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``spans`` (first, end) and, on
    request, ``kept`` (the bytes left; removal may cut a character).

    One row per row of ``docs``. Each byte covered by a string of ``length`` bytes that also
    starts anywhere else, in any text or place, is removed; matches never cross texts. A null
    text is empty. Rows repeated whole repeat each other's strings, also under one id.
    """
    # Not stored: in one plan, this join and the one that fetched the stretches share one deal of the texts.
    runs = repeated_spans(docs, id, text, length, **kw)
    joined = _with_lists(docs, runs, id, text, "left").select("doc", "text", "runs")
    span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            rows = []
            for t, r in zip(batch.column(1), batch.column(2)):
                data = memoryview(t.as_buffer()) if len(t.as_buffer()) else memoryview(b"")
                merged: list[list[int]] = []
                if r.is_valid:
                    start, n = (x.to_numpy() for x in r.values.flatten())
                    for a, b in sorted(zip(start.tolist(), (start + n + length - 1).tolist())):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                h, kept, at = hashlib.sha256(), [], 0
                for a, b in [*merged, [len(data), len(data)]]:
                    h.update(data[at:a])
                    if keep_text:
                        kept.append(bytes(data[at:a]))
                    at = b
                removed = sum(b - a for a, b in merged)
                rows.append((len(data), removed, len(merged), h.hexdigest(), [{"first": a, "end": b} for a, b in merged], b"".join(kept) if keep_text else None))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], [id, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    id_type = docs.schema[id].dataType.simpleString()
    out = joined.mapInArrow(run, f"`{id}` {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first: long, end: long>>, kept binary")
    return out if keep_text else out.drop("kept")
