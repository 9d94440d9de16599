"""Totals over the prefix trie of conversations, rolled up in bands of a fixed height.

A node is a distinct sequence of first turns. Its id comes from sums of digests of (place, turn),
so running sums name every prefix, and a very long conversation is summed in parts like any
other ordered scan. Every row is a few numbers; texts are read once, for their digests.

Totals over subtrees do not walk the tree level by level, and no node explodes to all its
ancestors. The levels are cut into bands. Inside a band every node adds to its ancestors of that
band only, at most ``BAND`` of them. The roots of the bands then form a trie of their own, lower
by the factor ``BAND``, whose values are the bands' totals: it is rolled up the same way. Its
completed totals go back to the ancestors in the band above each root. A trie of depth d takes
log(d) / log(BAND) such rounds, and a node is never in more than ``BAND`` rows of one.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import HOT_ROWS, ordered_scan
from ..session import materialize

BAND = 8
BLOB_BYTES = 64 << 10   # ids of one node that are joined before they meet the rest of its ids

_LANES = [f"_s{k}" for k in range(4)]
WORD = r"[^\x20\x09-\x0D]+"


def turn_rows(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
              hot_rows: int = HOT_ROWS) -> DataFrame:
    """``conv``, ``pos`` (from 0), ``digest``, ``words`` of every turn, in turn order per conversation.

    A missing turn number comes first, equal ones are ordered by the digest of role and text; null
    roles and texts are empty. Rows without an id belong to no conversation.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"),
        F.sha2(F.concat(F.sha2(F.coalesce(F.col(role), F.lit("")), 256), said), 256).alias("digest"),
        F.regexp_count(said, F.lit(WORD)).cast("long").alias("words"),
        # Only rows that are equal in all else are told apart by it, so that parts can be cut between them.
        F.monotonically_increasing_id().alias("_row"),
    )
    order = [F.col("turn"), F.col("digest"), F.col("_row")]
    stored = materialize(rows, "turns")
    return ordered_scan(stored, ["conv"], order, position="pos", hot_rows=hot_rows).select("conv", "pos", "digest", "words")


def _node(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth, *sums)))


def prefixes(turns: DataFrame, convs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``conv``, ``depth``, ``node``, ``parent``, ``words``: a row for every prefix of every
    conversation, that of no turn included. ``turns`` has ``conv``, ``depth`` (1, 2, ..), ``digest``,
    ``words``; ``convs`` the distinct ``conv``, also of conversations without turns."""
    hashed = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("digest")), 256)
    lanes = [F.conv(F.substring(hashed, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"_v{k}") for k in range(4)]
    summed = ordered_scan(
        turns.select("conv", "depth", "words", *lanes), ["conv"], [F.col("depth")], sums={s: f"_v{k}" for k, s in enumerate(_LANES)}, hot_rows=hot_rows
    )
    zero = _node(F.lit(0), [F.lit(0)] * 4)
    before = _node(F.col("depth") - 1, [F.col(s) - F.col(f"_v{k}") for k, s in enumerate(_LANES)])
    rows = summed.select("conv", F.col("depth").cast("long").alias("depth"), _node(F.col("depth"), [F.col(s) for s in _LANES]).alias("node"), before.alias("parent"), "words")
    roots = convs.select("conv", F.lit(0).cast("long").alias("depth"), zero.alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("words"))
    return rows.unionByName(roots)


def joined_ids_sha256(members: DataFrame, group: str, id: str, blob_bytes: int = BLOB_BYTES) -> DataFrame:
    """``group``, ``sha256``: hex digest of a group's ids as decimals, ascending, comma-joined.

    Ids are sorted in ranges of (group, id), so a very large group is cut over many tasks, each of
    which joins its ids to strings of bounded size. Only those strings meet, in order, and stream
    through one running digest.
    """
    group_type, id_type = (members.schema[c].dataType.simpleString() for c in (group, id))

    def blobs(batches):
        now, ids, size = None, [], 0
        for batch in batches:
            kinds, out = [*(batch.column(k).type for k in range(2)), pa.string()], []
            for g, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (g != now or size >= blob_bytes):
                    out.append((now, ids[0], ",".join(map(str, ids))))
                    ids, size = [], 0
                now = g
                ids.append(i)
                size += len(str(i)) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["g", "first", "ids"])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((now, ids[0], ",".join(map(str, ids))), kinds)], ["g", "first", "ids"])

    def digests(batches):
        now, held = None, None
        for batch in batches:
            kind, out = batch.column(0).type, []
            for g, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held is not None and g == now:
                    held.update(b"," + text.encode())
                    continue
                if held is not None:
                    out.append((now, held.hexdigest()))
                now, held = g, hashlib.sha256(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (kind, pa.string()))], [group, "sha256"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([held.hexdigest()])], [group, "sha256"])

    slim = members.select(F.col(group).alias("g"), F.col(id).alias("i"))
    cut = slim.repartitionByRange("g", "i").sortWithinPartitions("g", "i").mapInArrow(blobs, f"g {group_type}, first {id_type}, ids string")
    dealt = materialize(cut, "ids").repartition("g").sortWithinPartitions("g", "first")
    return dealt.select("g", "ids").mapInArrow(digests, f"`{group}` {group_type}, sha256 string")


def _bands(paths: DataFrame, nodes: DataFrame, values: list[str], band: int) -> DataFrame:
    """``conv``, ``band``, ``steps``: the parts of the paths, at most ``band`` steps each, that hold a
    node whose totals this conversation brings in. A step has ``depth``, ``node`` and the node's
    values where it does."""
    own = nodes.select(F.col("conv").alias("_c"), F.col("depth").alias("_d"), F.struct(*values).alias("own"))
    there = paths.select("conv", "depth", "node").join(own, (F.col("conv") == F.col("_c")) & (F.col("depth") == F.col("_d")), "left")
    steps = there.groupBy("conv", F.floor(F.col("depth") / band).alias("band")).agg(F.collect_list(F.struct("depth", "node", "own")).alias("steps"), F.count("own").alias("n"))
    return steps.where("n > 0").drop("n")


def rollup(paths: DataFrame, nodes: DataFrame, values: list[str], band: int = BAND) -> DataFrame:
    """``node`` and, under their own names, the sums of ``values`` over each node's subtree.

    ``paths`` has ``conv``, ``depth``, ``node`` (one row a place), ``nodes`` a row per node with
    ``node``, ``conv`` (a conversation through it), ``depth`` and the values. Both are read several
    times, so they should be stored.
    """
    deepest = nodes.agg(F.max("depth").alias("d")).first()["d"]
    if not deepest:
        return nodes.select("node", *values)
    steps = materialize(_bands(paths, nodes, values, band), "bands")
    below = lambda s, v: F.aggregate("steps", F.lit(0).cast("long"), lambda acc, t: acc + F.when(t["depth"] >= s["depth"], F.coalesce(t["own"][v], F.lit(0))).otherwise(0))
    given = steps.select(F.explode(F.transform("steps", lambda s: F.struct(s["node"].alias("node"), *[below(s, v).alias(v) for v in values]))).alias("s")).select("s.*")
    inside = materialize(given.groupBy("node").agg(*[F.sum(v).alias(v) for v in values]), "inside")
    roots = nodes.where(F.col("depth") % band == 0).select("node", "conv", F.floor(F.col("depth") / band).alias("depth"))
    roots = materialize(roots.join(inside, "node"), "band_roots")
    upper = paths.where(F.col("depth") % band == 0).select("conv", F.floor(F.col("depth") / band).alias("depth"), "node")
    done = rollup(upper, roots, values, band)
    # A band's root adds its completed total to its ancestors in the band above.
    moved = roots.where("depth > 0").select("conv", (F.col("depth") - 1).alias("band"), F.col("node").alias("root"))
    moved = moved.join(done.withColumnRenamed("node", "root"), "root").drop("root")
    above = paths.select("conv", F.floor(F.col("depth") / band).alias("band"), "node").join(moved, ["conv", "band"]).select("node", *values)
    return inside.unionByName(above).groupBy("node").agg(*[F.sum(v).alias(v) for v in values])


def trie(turns: DataFrame, convs: DataFrame, band: int = BAND, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per node: ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id`` (the
    parent's ``conv_id``, null for the root), ``n_convs`` (members), ``n_children``, ``n_leaves``
    (childless nodes of the subtree), ``saved_tokens`` (over the subtree, (members - 1) times the
    words of a node's last turn), ``ends_sha256`` (of the members that end at the node).

    ``turns`` and ``convs`` are as for :func:`prefixes`. Without conversations there is no node. The
    node's text is the last of the first ``depth`` turns of ``conv_id``.
    """
    paths = materialize(prefixes(turns, convs, hot_rows), "paths")
    nodes = paths.groupBy("node").agg(
        F.min("conv").alias("conv"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n_convs")
    )
    nodes = materialize(nodes, "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    own = nodes.join(children, "node", "left").select(
        "node", "conv", "depth", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    )
    own = materialize(own, "own")
    values = ["n_leaves", "saved_tokens"]
    totals = rollup(paths, own, values, band)
    ends = paths.groupBy("conv").agg(F.max_by("node", "depth").alias("node"))
    ends = joined_ids_sha256(ends, "node", "conv").withColumnRenamed("sha256", "ends_sha256")
    up = nodes.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"))
    out = own.drop(*values).join(totals, "node").join(up, "parent", "left").join(ends, "node", "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", *values,
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                      band: int = BAND, hot_rows: int = HOT_ROWS) -> DataFrame:
    """:func:`trie` of conversations as they are. Rows as for :func:`turn_rows`."""
    rows = materialize(turn_rows(conversations, conv, turn, role, text, hot_rows), "rows")
    return trie(rows.select("conv", (F.col("pos") + 1).alias("depth"), "digest", "words"), rows.select("conv").distinct(), band, hot_rows)


def with_borrowed_heads(rows: DataFrame, step: int, head: Column, longest: int) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) for :func:`trie` of conversations whose first ``head`` turns are replaced by those
    of conversation ``conv - conv % step`` (all, if that has fewer; none, if there is none).

    ``rows`` is a stored result of :func:`turn_rows`, ``head`` a Column of ``conv`` from 0 to
    ``longest``. At most ``step`` conversations share a head, so no key of the join is large.
    """
    convs = materialize(rows.select("conv").distinct().select("conv", head.cast("long").alias("h"), (F.col("conv") - F.col("conv") % step).alias("base")), "convs")
    heads = rows.where((F.col("pos") < longest) & (F.col("conv") % step == 0)).select(F.col("conv").alias("base"), "pos", "digest", "words")
    borrowed = convs.join(heads, "base").where("pos < h").select("conv", "pos", "digest", "words")
    have = borrowed.groupBy("conv").agg(F.count(F.lit(1)).alias("_k"))
    shift = convs.join(have, "conv", "left").select(F.col("conv").alias("_c"), "h", (F.coalesce("_k", F.lit(0)) - F.col("h")).alias("shift"))
    tail = rows.join(shift, F.col("conv") == F.col("_c")).where("pos >= h").select("conv", (F.col("pos") + F.col("shift")).alias("pos"), "digest", "words")
    turns = borrowed.unionByName(tail).select("conv", (F.col("pos") + 1).alias("depth"), "digest", "words")
    return materialize(turns, "rebuilt"), convs.select("conv")
