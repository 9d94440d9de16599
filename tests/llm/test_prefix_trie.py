"""The prefix trie against one built in a dictionary."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import prefix_trie as p

SCHEMA = "conv_id long, turn long, role string, text string, depth string, node int"


def ordered(rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    convs = {}
    for c, t, r, x, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, sha(sha(r or "") + (x or "")), r or "", x or ""))
    return {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}


def borrowed(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    nodes, kids = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    for key in nodes:
        if key:
            kids.setdefault(key[:-1], []).append(key)
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for key, members in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        for d in range(len(key) + 1):
            leaves[key[:d]] += key not in kids
            saved[key[:d]] += (len(members) - 1) * words
    out = []
    for key, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(convs[c]) == len(key)))
        parent = min(nodes[key[:-1]]) if key else None
        out.append((min(members), len(key), parent, len(members), len(kids.get(key, [])), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def talk(seed, n, longest=9, first=0):
    r = random.Random(seed)
    texts = ["a", "b  c", "", None, "d e\tf g", "x" * 50]
    rows = []
    for c in range(first, first + n):
        turns = [(c, k if r.random() < 0.9 else None, r.choice(["user", "assistant", None]), r.choice(texts[: 2 + (k > 1) * 4]), "d", k) for k in range(r.randint(1, longest))]
        rows += turns + turns[:1] * (r.random() < 0.1)
    return rows


@pytest.fixture(scope="module")
def rows():
    return [
        *talk(1, 130, first=-30), *talk(2, 20, longest=60, first=400), (None, 0, "user", "lost", None, None), (900, None, None, None, None, None), (900, None, None, None, None, None),
        *[(1000 + c, k, "user", f"t{k}", None, None) for c in range(40) for k in range(20)],
    ]


@pytest.mark.parametrize("band, hot", [(2, 1_000_000), (3, 25), (8, 1_000_000), (8, 100)])
def test_trie_and_borrowed_heads(spark, rows, band, hot):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    convs = ordered(rows)
    if band == 2:
        assert rows_of(p.conversation_trie(frame, band=band, hot_rows=hot)) == brute(convs)
    turns = spark.read.schema("conv long, pos long, digest string, words long").parquet(_stored(spark, frame, hot))
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    assert rows_of(p.trie(*p.with_borrowed_heads(turns, 20, head, 3), band, hot)) == brute(borrowed(convs))


def _stored(spark, frame, hot):
    from ledgerspark.session import fresh_path

    path = fresh_path(spark, "test")
    p.turn_rows(frame, hot_rows=hot).write.parquet(path)
    return path


def test_one_conversation_with_most_turns_and_one_end_with_most_members(spark):
    rows = [(1, k, "user", f"w {k % 7}", None, None) for k in range(3000)] + [(c, 0, "user", "hello", None, None) for c in range(2, 1500)]
    got = p.conversation_trie(spark.createDataFrame(rows, SCHEMA), band=4, hot_rows=500).orderBy("depth", "conv_id").collect()
    assert len(got) == 3002 and got[0]["n_convs"] == 1499 and got[0]["n_leaves"] == 2 and got[0]["saved_tokens"] == 1497
    hello = next(r for r in got if r["conv_id"] == 2)
    assert hello["ends_sha256"] == hashlib.sha256(",".join(map(str, range(2, 1500))).encode()).hexdigest()


def test_ids_are_joined_over_blobs(spark):
    members = spark.createDataFrame([(k % 3, k - 50) for k in range(500)], "g int, i long").repartition(7)
    got = {r["g"]: r["sha256"] for r in p.joined_ids_sha256(members, "g", "i", blob_bytes=40).collect()}
    assert got == {g: hashlib.sha256(",".join(str(k - 50) for k in range(500) if k % 3 == g).encode()).hexdigest() for g in range(3)}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert p.conversation_trie(none).count() == 0
    assert p.conversation_trie(spark.createDataFrame([("x", 1, None, None)], "conv_id string, turn int, role string, text string")).count() == 2
