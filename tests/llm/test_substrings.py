"""Suffix sorting, repeated strings and content-defined chunks, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ledgerspark.llm import chunks, substrings, suffix_sort

from .helpers import awkward_docs, no_docs, prose


@pytest.mark.parametrize("symbols", [1, 48])
def test_suffix_array_and_prefixes(monkeypatch, symbols):
    monkeypatch.setattr(suffix_sort, "SYMBOLS_A_BUCKET", symbols)
    rng = np.random.default_rng(0)
    for t in range(150):
        s = np.append(rng.integers(1, int(rng.integers(1, 5)) + 1, int(rng.integers(1, 80))), 0)
        s = np.append(np.tile(s[:-1], 3), 0) if t % 3 == 0 else s
        sa = suffix_sort.suffix_array(s)
        want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        assert sa.tolist() == want
        shared = suffix_sort.permuted_prefixes(s, sa)
        for a, b in zip(want[1:], want[:-1]):
            n = 0
            while max(a, b) + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            assert shared[a] == n


def brute(rows, length):
    seen = Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = []
    for k, t in rows:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if mark[i] and (i == 0 or not mark[i - 1]))
        out.append((k, len(t), sum(mark), spans, hashlib.sha256(bytes(b for b, m in zip(t, mark) if not m)).hexdigest()))
    return Counter(out)


def result(df):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


@pytest.mark.parametrize("kw", [{}, {"hot": 2}, {"shard_bytes": 500}])
def test_removed_strings(spark, kw):
    docs = awkward_docs(spark)
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    assert result(substrings.remove_repeated(docs, **kw)) == brute(rows, substrings.LENGTH)
    kept = substrings.remove_repeated(docs, keep_text=True, **kw).collect()
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in kept)


def test_removed_strings_of_random_texts(spark):
    r = random.Random(9)
    bits = [bytes(r.choice(b"abc ") for _ in range(r.randint(20, 160))).decode() for _ in range(12)]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 12)))) for i in range(80)] + [(100, "z" * 500), (101, "xy" * 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(substrings.remove_repeated(docs, length=64)) == brute([(i, t.encode()) for i, t in rows], 64)


def test_long_texts_are_taken_in_segments(monkeypatch):
    data = np.random.default_rng(2).integers(0, 256, 30_000).astype(np.uint8)
    offsets = np.array([0, 30_000])
    whole = substrings.stretches(data, offsets)
    monkeypatch.setattr(substrings, "SEGMENT", 7000)
    parts = substrings.stretches(data, offsets)
    cover = lambda x: sorted((a, a + i) for a, n in zip(x[1].tolist(), x[2].tolist()) for i in range(n))
    assert len({a + i for a, i in cover(whole)}) and sorted(a + i for _, a, n, *_ in zip(*whole) for i in range(n)) == sorted(a + i for _, a, n, *_ in zip(*parts) for i in range(n))


def test_passages_are_found_by_length(spark):
    """From 400 bytes on all of a passage that two foreign texts share, below nothing; clean texts stay whole."""
    r = random.Random(12)
    noise = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    rows, want = [(9999, noise(3000))], {9999: []}
    for k, size in enumerate([300, 350, 399, 400, 401, 450, 600, 1000] * 3):
        passage = noise(size)
        for i in (2 * k, 2 * k + 1):
            # The bytes beside a passage differ from copy to copy.
            before, after = noise(r.randint(0, 900)) + "<>"[i % 2], "<>"[i % 2] + noise(r.randint(0, 900))
            rows.append((i, before + passage + after))
            want[i] = [(len(before), len(before) + size)] if size >= 400 else []
    out = substrings.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {x["doc_id"]: [tuple(y) for y in x["spans"]] for x in out.collect()} == want


def test_no_documents(spark):
    assert substrings.remove_repeated(no_docs(spark)).count() == 0
    assert chunks.remove_repeated_chunks(no_docs(spark)).count() == 0


def plain_chunks(t: bytes):
    out, last, h = [], 0, 0
    for i, b in enumerate(t):
        h = ((h << 1) + int(chunks.GEAR[b])) & 0xFFFFFFFF
        n = i + 1 - last
        if n >= chunks.LEAST and h >> (32 - chunks.CUT_BITS) == 0 or n == chunks.MOST:
            out.append((last, i + 1))
            last = i + 1
    return out + [(last, len(t))] * (last < len(t))


def test_chunks(spark):
    docs = awkward_docs(spark)
    rows = docs.collect()
    texts = [(r["text"] or "").encode() for r in rows]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    doc, end = chunks.chunk_ends(data, offsets)
    for i, t in enumerate(texts):
        assert (end[doc == i] - offsets[i]).tolist() == [b for _, b in plain_chunks(t)]
    seen, first = Counter(), {}
    good = lambda a, b, t: b - a >= chunks.LEAST or b - a == len(t)
    for r, t in sorted(zip(rows, texts), key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"])):
        for a, b in plain_chunks(t):
            if good(a, b, t):
                seen[t[a:b]] += 1
                first.setdefault(t[a:b], (r["doc_id"], a))
    want = Counter()
    for r, t in zip(rows, texts):
        runs = []
        for a, b in plain_chunks(t):
            if good(a, b, t) and seen[t[a:b]] > 1:
                if not runs or runs[-1][-1][1] != a:
                    runs.append([])
                runs[-1].append((a, b, first[t[a:b]] != (r["doc_id"], a)))
        runs = [x for x in runs if x[-1][1] - x[0][0] >= min(chunks.LEAST_RUN, len(t))]
        want[(r["doc_id"], len(t), len(plain_chunks(t)), sum(x[-1][1] - x[0][0] for x in runs), sum(b - a for x in runs for a, b, later in x if later))] += 1
    got = Counter((r["doc_id"], r["n_bytes"], r["n_chunks"], r["n_repeated"], r["n_removed"]) for r in chunks.remove_repeated_chunks(docs).collect())
    assert got == want


def test_an_insertion_changes_the_chunks_around_it_alone():
    t = bytes(random.Random(1).choice(b"abcdefgh ") for _ in range(20_000))
    cut = lambda x: {x[a:b] for a, b in plain_chunks(x)}
    assert len(cut(t) - cut(t[:9000] + b"inserted" + t[9000:])) <= 6


def test_passages_of_51_words_in_foreign_texts_are_found(spark):
    rows, size = [], {}
    for k in range(200):
        passage = prose(10_000 + k, 51)
        size[2 * k + 1] = len(passage.encode())
        for i in (2 * k, 2 * k + 1):
            rows.append((i, f"{prose(20_000 + i, 20 + i % 37)} {passage} {prose(30_000 + i, 20 + i % 41)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    gone = {r["doc_id"]: r["n_removed"] for r in chunks.remove_repeated_chunks(docs).collect()}
    shares = [min(gone[i], n) / n for i, n in size.items()]
    assert not any(gone[i] for i in range(0, 400, 2))
    assert sum(s == 0 for s in shares) <= 4 and sum(shares) / len(shares) >= 0.72
