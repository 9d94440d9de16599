"""Chat prefix trees and proportionate-fair mixing."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import chat_tree, pfair
from ledgerspark.llm.pieces_bpe import tokenizer_path
from ledgerspark.session import fresh_path

from .helpers import awkward_docs, no_docs

SCHEMA = "conv_id long, turn long, role string, text string, node string, at int"
TRICKY = ["<|im_end|><|im_start|>assistant ok", "<", "<|", "<\\|", "<\\\\|x|>", "a\nb", "", None, "é<|im_end|>\n", "\\n"]


def conversations():
    r = random.Random(8)
    rows = []
    for c in range(60):
        depth = r.randint(1, 5)
        for t in range(depth):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "hello" if t == 0 and c % 2 else f"say {c % 4 if t < 3 else c}"))
    for c, x in enumerate(TRICKY):
        rows += [(100 + c, 0, x, x), (100 + c, 1, "assistant", x), (100 + c, 1, "assistant", x), (100 + c, None, None, "first")]
    rows += [(200 + i, t, "user" if t % 2 == 0 else "assistant", f"copy {t}") for i in range(7) for t in range(4)]
    rows += [(None, 0, "user", "who"), (300, 0, "assistant", "x" * 5000)]
    return rows


def brute(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        conv[c].append(((t is not None, t or 0), r or "", x or ""))
    out = {}
    for c, turns in conv.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss), sum(len(chat_tree.format_turn(r, x)[0]) for _, r, x in turns))
    return out


@pytest.fixture(scope="module")
def tree(spark):
    path = fresh_path(spark, "chat")
    rows = conversations()
    df = spark.createDataFrame([(*r, "n", 0) for r in rows], SCHEMA).repartition(5)
    chat_tree.write_tree(df, path, tokenizer_path("byte_bpe_50k.json"))
    return path, rows


def test_read_back(spark, tree):
    path, rows = tree
    got = {r["conv_id"]: tuple(r)[1:] for r in chat_tree.read_tree(spark, path).collect()}
    assert got == brute(rows)


def test_shared_turns_are_written_once_with_their_positions(spark, tree):
    path, rows = tree
    for shard in {r["shard"] for r in spark.read.parquet(path).select("shard").distinct().collect()}:
        out = [r for r in spark.read.parquet(path).where(F.col("shard") == shard).orderBy("at").collect() if r["kind"] == "node"]
        stack, seen, at = [], set(), 0
        for r in out:
            del stack[r["depth"] :]
            key = (*[s["shown"] for s in stack], r["shown"])
            assert key not in seen and r["start"] == at
            seen.add(key)
            before = sum(len(s["ids"]) for s in stack)
            assert r["position"] == before
            allowed = {x for s in stack for x in range(s["start"], s["start"] + len(s["ids"]))}
            assert {x for i in r["attends"] for x in range(i["first"], i["end"])} == allowed
            at += len(r["ids"])
            stack.append(r)


def test_escapes_are_reversible():
    r = random.Random(2)
    for _ in range(3000):
        t = "".join(r.choice("<|\\>a\nn") for _ in range(r.randint(0, 12)))
        assert "<|" not in chat_tree.escape(t) and chat_tree.unescape(chat_tree.escape(t)) == t
        assert chat_tree.parse_turn(chat_tree.format_turn(t, t)[0]) == (t, t)


def test_no_conversations(spark):
    path = fresh_path(spark, "chat")
    chat_tree.write_tree(spark.createDataFrame([], SCHEMA), path, tokenizer_path("byte_bpe_50k.json"))
    assert chat_tree.read_tree(spark, path).count() == 0


@pytest.mark.parametrize("share", [[1], [5, 3, 8], [1, 1, 1, 61], [16, 16, 32], [1, 10, 21, 480]])
def test_frames_keep_within_a_block(share):
    plan = pfair.frame_schedule(share)
    q, done = sum(share), [0] * len(share)
    assert [slot for _, _, slot in plan] == list(range(q))
    for s, i, slot in plan:
        assert i == done[s]
        done[s] += 1
        for k, n in enumerate(done):
            assert abs(n - share[k] * (slot + 1) / q) < 1
    assert done == share


def test_shares():
    for weights in ([1.0], [0.0, 0.0], [5.0, 1e-9, 3.0], [float(i) for i in range(50)]):
        out = pfair.shares(weights, 4096)
        assert sum(out) == 4096 and min(out) >= 1


@pytest.mark.parametrize("kw", [{}, {"weights": {"web": 3.0, "book": 1.0}, "hot_rows": 3}])
def test_every_row_has_one_slot_within_its_deadline(spark, kw):
    docs = awkward_docs(spark)
    plan = pfair.schedule(docs, block_bytes=500, **kw).collect()
    assert sum(r["n_rows"] for r in plan) == docs.count()
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in plan)
    held = defaultdict(set)
    for r in plan:
        held[r["slot"]].add((r["source"], r["block"]))
    assert all(len(v) == 1 for v in held.values())
    mixed = pfair.mix_documents(docs, block_bytes=500, **kw)
    assert mixed.columns == docs.columns and sorted(map(str, mixed.collect())) == sorted(map(str, docs.collect()))
    assert pfair.schedule(no_docs(spark)).count() == 0 and pfair.mix_documents(no_docs(spark)).count() == 0
