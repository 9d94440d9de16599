"""Benchmark passages against a search by brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import decontaminate as d

from .helpers import awkward_docs, no_docs, words


def brute(docs, bench, n=13):
    windows = {}
    for i, t in bench:
        w = words(t)
        for j in range(max(len(w) - n, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add("" if i is None else str(i))
    out = {}
    for k, t in docs:
        w, hit, items = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for j in range(len(w) - size + 1):
                found = windows.get(tuple(w[j : j + size]))
                if found:
                    items |= found
                    hit.update(range(j, j + size))
        out[k] = (len(w), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("part_bytes", [d.PART_BYTES, 300])
def test_against_brute_force(spark, part_bytes):
    r = random.Random(5)
    text = lambda n: " ".join(r.choice("aa b cc d E é7".split()) for _ in range(n))
    items = [(i, text(r.randint(0, 30))) for i in range(25)] + [(3, "aa b"), (98, None), (None, text(20)), (99, "zz"), (97, "...")]
    docs = [(i, r.choice(["", "x, "]) + text(r.randint(0, 60)) + r.choice(["", " ", "! "]) + r.choice(items)[1] * 1 if r.random() < 0 else text(r.randint(0, 60)) + " " + (r.choice(items)[1] or "")) for i in range(120)]
    docs += [(200, None), (201, ""), (202, text(3000)), (203, "zz zz zz"), (204, items[0][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, doc_id string")
    marked = d.mark(frame, bench, part_bytes=part_bytes)
    got = {x["doc_id"]: (x["w"], x["h"], sorted(x["i"]), x["c"]) for x in marked.select("doc_id", F.col(d.WORDS).alias("w"), d.n_hit().alias("h"), F.col(d.ITEMS).alias("i"), d.contaminated().alias("c")).collect()}
    want = brute(docs, items)
    assert got == want
    kept = d.remove_contaminated(frame, bench, part_bytes=part_bytes)
    assert kept.columns == frame.columns and {x["doc_id"] for x in kept.collect()} == {k for k, v in want.items() if not v[3]}


def test_suffix_array_order():
    rng = np.random.default_rng(1)
    words_ = np.append(rng.integers(1, 4, 200), np.zeros(6, int)).astype(np.uint64)
    sa = d.suffix_array(words_, np.arange(200), 6)
    keys = [words_[i : i + 6].tolist() for i in sa]
    assert keys == sorted(keys) and sorted(sa.tolist()) == list(range(200))


def test_awkward_rows(spark):
    docs, bench = awkward_docs(spark), spark.createDataFrame([(1, "one two", 5)], "item_id long, text string, key int")
    kept = d.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and docs.count() - kept.count() == 2
    assert d.remove_contaminated(no_docs(spark), bench).count() == 0
    assert d.remove_contaminated(docs, bench.limit(0)).count() == docs.count()
