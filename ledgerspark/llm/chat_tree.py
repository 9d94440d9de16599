"""Conversations as a prefix tree: shared initial turns are written once, depth first.

A turn's node is the digest of all turns up to it, so conversations that begin alike share
nodes. Conversations are ranked by their shared nodes; ranges of that order are shards, and
one pass over a shard's ordered turns emits each node once, right after its ancestors and
earlier siblings' subtrees. A node carries its tokens, their position ids (counted along its
own path) and the stretches of the shard that it may attend to (its ancestors' tokens). Where
a shard begins amid a subtree, the shared turns are written again, so that it stands alone.

Nothing holds the texts of a whole conversation: turns stream through in order. What is kept
of the current path (nodes, positions, intervals, running digests) and what ranking collects
of a shared path grow with its turns, in one task's memory.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import global_rank
from ..session import materialize

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
RANK_ROWS = 8_000  # conversations one task ranks

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No control string is left: every ``<|``, ``<\\|``, .. gets one more backslash."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn in template form, and where its text lies."""
    head = START + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse_turn(shown: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    role, _, rest = shown.removeprefix(START).partition("\n")
    plain = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))
    return plain, unescape(rest[: -len(END) - 1])


def chained_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn, in turn order per conversation: ``conv``, ``depth``, ``node``,
    ``role``, ``text``, ``last``. Equal turn numbers are ordered by role and text, a missing
    number comes first; null roles and texts are empty; a null id is a conversation."""
    slim = conversations.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    conv_type = slim.schema["conv"].dataType.simpleString()
    names = ["conv", "depth", "node", "role", "text", "last"]

    def run(batches):
        now, depth, chain, held = object(), 0, b"", None

        def out(rows):
            cols = list(zip(*rows))
            kinds = [conv_kind, pa.int32(), pa.binary(), pa.string(), pa.string(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        conv_kind = None
        for batch in batches:
            conv_kind = batch.column(0).type
            rows = []
            for c, r, t in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                if c != now:
                    if held:
                        rows.append((*held, True))
                    now, depth, chain = c, 0, b""
                elif held:
                    rows.append((*held, False))
                h = hashlib.blake2b(chain, digest_size=16)
                h.update(f"{len(r)} ".encode() + r.encode() + t.encode())
                chain = h.digest()
                held = (c, depth, chain, r, t)
                depth += 1
            if rows:
                yield out(rows)
        if held:
            yield out([(*held, True)])

    dealt = slim.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return dealt.select("conv", "role", "text").mapInArrow(run, f"conv {conv_type}, depth int, node binary, role string, text string, last boolean")


def ranked(turns: DataFrame) -> DataFrame:
    """``conv``, ``place``: conversations in the order of their paths, so that those which
    share turns are neighbours. A path is cut where no other conversation shares it."""
    shared = turns.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("node").alias("_node"), F.lit(True).alias("_shared"))
    steps = turns.select("conv", "depth", "node").join(shared, F.col("node") == F.col("_node"), "left").where("depth = 0 OR _shared")
    paths = steps.groupBy("conv").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "node"))), lambda s: s["node"]).alias("path"))
    return global_rank(materialize(paths, "paths"), [F.col("path"), F.col("conv")], name="place", hot_rows=RANK_ROWS).select("conv", "place")


def write_tree(conversations: DataFrame, path: str, tokenizer: str, **columns) -> None:
    """Write the shards as Parquet rows in emission order (``shard``, ``at``).

    ``kind`` is ``node`` or ``leaf``. A node has ``depth``, ``shown`` (the formatted turn),
    ``loss_first``/``loss_end`` (characters of it under the loss mask), ``ids``, ``start`` (its
    first token in the shard), ``position`` (its first position id) and ``attends`` (token
    intervals of its ancestors, joined where they touch). A leaf says that conversation
    ``conv`` ends at the node emitted or passed last at its ``depth``.
    """
    turns = materialize(chained_turns(conversations, **columns), "turns")
    places = ranked(turns).select(F.col("conv").alias("_conv"), "place")
    placed = turns.join(places, F.col("conv").eqNullSafe(F.col("_conv")))
    dealt = placed.repartitionByRange("place").sortWithinPartitions("place", "depth")
    conv_type = turns.schema["conv"].dataType.simpleString()
    interval = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    names = ["shard", "at", "kind", "conv", "depth", "shown", "loss_first", "loss_end", "ids", "start", "position", "attends"]

    def run(batches):
        from tokenizers import Tokenizer

        enc = Tokenizer.from_file(tokenizer)
        enc.encode_special_tokens = True
        encode = lambda s: enc.encode(s, add_special_tokens=False).ids
        shard, at, start = TaskContext.get().partitionId(), 0, 0
        stack: list = []  # per depth: node, position after it, intervals up to and with it
        for batch in batches:
            rows = []
            kind = batch.column(0).type
            for conv, depth, node, role, text, last in zip(*[batch.column(k).to_pylist() for k in range(6)]):
                if depth >= len(stack) or stack[depth][0] != node:
                    del stack[depth:]
                    shown, a, b = format_turn(role, text)
                    ids = [*encode(shown[:a]), *encode(shown[a:b]), *encode(shown[b:])]
                    position, seen = (stack[-1][1], stack[-1][2]) if stack else (0, ())
                    loss = (a, b) if role == TRAINED_ROLE else (0, 0)
                    shown_to = [{"first": x, "end": y} for x, y in seen]
                    rows.append((shard, at, "node", None, depth, shown, *loss, ids, start, position, shown_to))
                    end = start + len(ids)
                    own = (*seen[:-1], (seen[-1][0], end)) if seen and seen[-1][1] == start else (*seen, (start, end))
                    stack.append((node, position + len(ids), own))
                    start, at = end, at + 1
                if last:
                    rows.append((shard, at, "leaf", conv, depth, None, None, None, None, None, None, None))
                    at += 1
            if rows:
                kinds = [pa.int32(), pa.int64(), pa.string(), kind, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.int64(), interval]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = (
        f"shard int, at long, kind string, conv {conv_type}, depth int, shown string, loss_first int, loss_end int, "
        "ids array<int>, start long, position long, attends array<struct<first: long, end: long>>"
    )
    dealt.select("conv", "depth", "node", "role", "text", "last").mapInArrow(run, schema).write.parquet(path)


def read_tree(spark: SparkSession, path: str, conv: str = "conv_id") -> DataFrame:
    """Per conversation, from the written shards alone: ``n_turns``, ``turns_sha256``,
    ``loss_chars``, ``loss_sha256`` and ``formatted_chars``. The running digests of a path are
    copied at each branch, so a shared turn is hashed once."""
    rows = spark.read.parquet(path)
    conv_type = rows.schema["conv"].dataType.simpleString()
    dealt = rows.select("shard", "at", "kind", "conv", "depth", "shown", "loss_first", "loss_end")
    dealt = dealt.repartitionByRange("shard").sortWithinPartitions("shard", "at")
    names = [conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        stack: list = []
        for batch in batches:
            out = []
            for _, _, kind, name, depth, shown, a, b in zip(*[batch.column(k).to_pylist() for k in range(8)]):
                if kind == "leaf":
                    turns, loss, chars, total = stack[depth]
                    out.append((name, depth + 1, turns.hexdigest(), chars, loss.hexdigest(), total))
                    continue
                del stack[depth:]
                turns, loss, chars, total = stack[-1] if stack else (hashlib.sha256(), hashlib.sha256(), 0, 0)
                role, text = parse_turn(shown)
                turns, loss = turns.copy(), loss.copy()
                turns.update(f"{role}\n{text}\n".encode())
                masked = unescape(shown[a:b])
                loss.update(masked.encode())
                stack.append((turns, loss, chars + len(masked), total + len(shown)))
            if out:
                kinds = [batch.column(3).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return dealt.mapInArrow(run, f"`{conv}` {conv_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
