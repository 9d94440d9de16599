"""Spelling variants against all pairs, and the trees against plain distances."""

import random
import re
import zlib

import numpy as np
import pytest

from ledgerspark.llm import spelling as s

from .helpers import awkward_docs, no_docs


def edits(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=10):
    form, out = {}, {}
    for w, n in counts.items():
        near = sorted((-counts[x], x) for x in counts if abs(len(x) - len(w)) <= 1 and edits(w, x))
        best = near[0] if near and -near[0][0] >= ratio * n else (None, None)
        form[w] = best[1]
        out[w] = [best[1], None, n, len(near), None if best[1] is None else -best[0]]
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return sorted((w, *x) for w, x in out.items())


def rows_of(frame):
    return sorted(map(tuple, frame.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def vocabulary(seed, n=500, long=False):
    r = random.Random(seed)
    letters = "abcdeéÿ"
    base = ["".join(r.choice(letters) for _ in range(r.randint(1, 12))) for _ in range(n // 5)] + ["q" * 3000 + c for c in "ab" * long]
    out = {}
    for w in base * 5:
        k = r.randrange(len(w) + 1)
        w = r.choice([w, w[:k] + r.choice(letters + "日") + w[k:], w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k + 1 :], "".join(r.sample(w, len(w))) if len(w) < 99 else w])
        if w:
            out[w] = int(10 ** r.uniform(0, 4))
    return out


@pytest.mark.parametrize("fit, box, part, leaf", [(s.FIT_WORDS, s.BOX_WORDS, s.PART_WORDS, 64), (s.FIT_WORDS, 20, s.PART_WORDS, 4), (40, 7, 9, 2), (0, 50, 30, 8)])
def test_against_all_pairs(spark, monkeypatch, fit, box, part, leaf):
    for name, value in (("FIT_WORDS", fit), ("BOX_WORDS", box), ("PART_WORDS", part), ("_LEAF", leaf)):
        monkeypatch.setattr(s, name, value)
    counts = vocabulary(fit + box, long=fit > 100)
    frame = spark.createDataFrame([*counts.items(), (None, 5), ("", 7), ("zzzz", None)], "word string, n long").repartition(4)
    want = brute(counts)
    assert rows_of(s.variants(frame)) == want and sum(x[1] is not None for x in want) > 30 and any(x[1] != x[2] for x in want if x[1])


def test_words_of_documents(spark):
    docs = awkward_docs(spark)
    want = {}
    for row in docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", row["text"] or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if row['doc_id'] is None else row['doc_id']}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            if len(word) >= 7:
                want[word] = want.get(word, 0) + 1
    assert {r["word"]: r["n"] for r in s.word_counts(docs).collect()} == want and len(want) > 500
    assert rows_of(s.spelling_variants(docs)) == brute({w: n for w, n in want.items() if n >= 2})
    assert s.spelling_variants(no_docs(spark)).count() == 0
    odd = spark.createDataFrame([("a", "ÉCOLEÉCOLE ×÷×÷×÷× Ābcdefghij İstanbul", "w", 1)] * 2, "doc_id string, text string, word string, n int")
    assert {r["word"] for r in s.word_counts(odd).collect()} <= {"ÉcoleÉcole", "bcdefghij", "×÷×÷×÷×", "stanbul"}


def test_boxes_are_never_pruned_wrongly():
    r = np.random.default_rng(3)
    counts = r.poisson(0.4, (400, s.DIMS)).astype(np.int32)
    tree = s.Tree.fit(counts, 5)
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(400))
    assert all(len(set(map(tuple, counts[x]))) == 1 or len(x) <= 5 for x in tree.leaves)
    place = tree.place(counts)
    assert all((place[x] == k).all() for k, x in enumerate(tree.leaves))
    for up, down in ((1, 1), (1, 0)):
        visits = {(int(i), leaf) for leaf, rows in tree.reach(counts, up, down) for i in rows}
        for i in range(400):
            gap = counts - counts[i]
            for j in np.flatnonzero((np.maximum(gap, 0).sum(1) <= up) & (np.maximum(-gap, 0).sum(1) <= down)):
                assert (i, int(place[j])) in visits
        assert len(visits) < 0.6 * 400 * len(tree.leaves)


def test_ratio(spark):
    with pytest.raises(ValueError):
        s.variants(spark.createDataFrame([("a", 1)], "word string, n long"), ratio=1)
