"""ProbMinHash near-duplicates, components and the Voronoi join, against brute force."""

from collections import Counter

import numpy as np
import pytest

from ledgerspark.llm import probminhash as p
from ledgerspark.llm import voronoi
from ledgerspark.llm.components import components

from .helpers import awkward_docs, no_docs, prose, words


def plain_similarity(a: Counter, b: Counter) -> float:
    every = set(a) | set(b)
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in every) for i in set(a) & set(b))


def shingled(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def vector(c: Counter, names: dict):
    x = sorted((names[k], v) for k, v in c.items())
    return np.array([k for k, _ in x], np.uint64), np.array([v for _, v in x], float)


def test_probability_jaccard_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = (Counter({int(i): int(rng.integers(1, 4)) for i in rng.integers(0, 12, 8)}) for _ in range(2))
        names = {i: i for i in range(12)}
        want = plain_similarity(a, b)
        x, y = vector(a, names), vector(b, names)
        assert p.probability_jaccard(x, y) == pytest.approx(want)
        assert p.overlap(x, y) / (2 - p.overlap(x, y)) <= want + 1e-12 <= p.overlap(x, y) + 1e-9
        assert p.similar(x, y, 0.5) == (want >= 0.5 - 1e-9)


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(4)
    close = []
    for size in (1, 3, 30, 300):
        for _ in range(30):
            names = rng.integers(1, 2**62, size, dtype=np.uint64)
            a = np.sort(np.unique(names))
            b = np.sort(np.unique(np.concatenate([names[: max(1, size * 4 // 5)], rng.integers(1, 2**62, max(0, size // 10), dtype=np.uint64)])))
            wa, wb = rng.integers(1, 3, len(a)), rng.integers(1, 3, len(b))
            s = p.signatures(np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([len(a), len(b)]))
            assert (s > 0).all() and np.isin(s[0], a).all()
            close.append((s[0] == s[1]).mean() - p.probability_jaccard((a, wa.astype(float)), (b, wb.astype(float))))
    assert abs(np.mean(close)) < 0.01 and np.std(close) < 0.05


def test_signatures_do_not_depend_on_the_batch():
    rng = np.random.default_rng(5)
    parts = [np.unique(rng.integers(1, 2**62, n, dtype=np.uint64)) for n in (5, 0, 200, 1)]
    together = p.signatures(np.concatenate(parts), np.ones(sum(map(len, parts))), np.array([len(x) for x in parts]))
    for x, row in zip(parts, together):
        assert np.array_equal(p.signatures(x, np.ones(len(x)), np.array([len(x)]))[0], row)


def brute_classes(rows):
    """The least id of the class of every (id, text); an id alone links nothing."""
    flat = [(i, t, shingled(t)) for i, t in dict.fromkeys(rows)]
    up = list(range(len(flat)))

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for n, (_, s, a) in enumerate(flat):
        for m, (_, t, b) in enumerate(flat[:n]):
            if (plain_similarity(a, b) >= 0.8 - 1e-9) if a and b else (not a and not b and (s or "") == (t or "")):
                up[find(n)] = find(m)
    least = {}
    for n, (i, _, _) in enumerate(flat):
        least[find(n)] = min(i, least.get(find(n), i))
    return {(i, t): least[find(n)] for n, (i, t, _) in enumerate(flat)}


@pytest.mark.parametrize("limits", [{}, {"BUCKET": 2, "BLOCK": 2, "BROADCAST_IDS": 0}])
def test_classes(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(p, k, v)
    extra = []
    base = prose(20, 120).split()
    for i in range(12):
        w = list(base)
        for k in range(i % 4 * 2):
            w[(7 * i + 11 * k) % 120] = f"edit{i}x{k}"
        extra.append((300 + i, " ".join(w) + (" again and again" if i % 5 == 0 else "")))
    rows = [(r["doc_id"], r["text"]) for r in awkward_docs(spark).collect()] + extra
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, class_id int").repartition(3)
    out = p.near_duplicates(docs).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in rows)
    want = brute_classes([(i, t) for i, t in rows if i is not None])
    assert Counter((r["doc_id"], r["class_id"]) for r in out if r["doc_id"] is not None) == Counter((i, want[i, t]) for i, t in rows if i is not None)
    assert all(r["class_id"] is None for r in out if r["doc_id"] is None)
    kept = p.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([*set(want.values()), *[None] * sum(i is None for i, _ in rows)])


@pytest.mark.parametrize("seed", [2018, 4595, 5674])
def test_pairs_at_the_threshold_with_a_low_estimate(spark, seed):
    w = [f"w{seed}x{k}" for k in range(229)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:204] + [f"v{seed}x{k}" for k in range(25)]))]
    assert plain_similarity(*[shingled(t) for _, t in rows]) == pytest.approx(0.8)
    out = p.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["class_id"] for r in out] == [1, 1]


@pytest.mark.parametrize("kind, name", [("long", int), ("string", "id{}".format)])
def test_unrelated_texts_of_one_id(spark, kind, name):
    a, b, c = (prose(n, 60) for n in (50, 51, 52))
    rows = [(name(i), t) for i, t in [(5, a), (5, b), (6, b), (7, c), (8, c + " end"), (5, a)]]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)
    want = brute_classes(rows)
    got = p.near_duplicates(docs)
    assert dict(got.dtypes)["class_id"] == dict(docs.dtypes)["doc_id"]
    assert Counter((r["doc_id"], r["class_id"]) for r in got.collect()) == Counter((i, want[i, t]) for i, t in rows)
    assert sorted(map(tuple, p.keep_one(docs).collect())) == sorted([(name(5), a), (name(5), b), (name(7), c)])


def test_an_id_with_texts_of_two_classes(spark):
    a, b = prose(40, 60), prose(41, 60)
    docs = spark.createDataFrame([(2, a), (5, a), (5, b), (7, b)], "doc_id long, text string").repartition(3)
    assert {(r["doc_id"], r["text"]) for r in p.keep_one(docs).collect()} == {(2, a), (5, b)}
    assert p.keep_one(docs).count() == 2


def test_no_documents(spark):
    assert p.near_duplicates(no_docs(spark)).count() == 0 and p.keep_one(no_docs(spark)).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 1), (5, 4), (7, 7), (None, 1), (9, 8), (8, 10), (10, 11), (11, 12), (12, 13), (13, 14)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 8: 8, 9: 8, 10: 8, 11: 8, 12: 8, 13: 8, 14: 8}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_nearest(rows, k):
    out = []
    for q, v in sorted({(i, tuple(v)) for i, v in rows if i % 100 == 0}):
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return Counter(out)


@pytest.mark.parametrize("kw", [{}, {"n_pivots": 5, "group": 2, "block": 20}])
@pytest.mark.parametrize("spread", [1.0, 0.02])
def test_nearest(spark, kw, spread):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(8, 6))
    rows = [(int(i), (centre[i % 8] + spread * rng.normal(size=6)).tolist()) for i in range(320)]
    rows += [(17, rows[17][1]), (400, rows[0][1]), (500, [0.5, -0.5]), (600, []), (700, None), (701, [1.0, None]), (None, [1.0] * 6), (702, [float("nan")] * 6), (703, [float("inf")])]
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<double>, cell string, rank int").repartition(4)
    vectors = voronoi.whole_vectors(df)
    got = voronoi.nearest(vectors, vectors.where("vec_id % 100 = 0"), **kw)
    good = [(i, np.floor(1024 * np.array(v)).astype(int).tolist()) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == brute_nearest(good, 10)


def test_bounds_leave_far_cells_out():
    cells = voronoi.Cells(np.array([[100, 0], [-100, 0], [0, 100]]), 10000.0)
    ring = voronoi.rings(cells, {0: (50, 0.0, 1.0), 1: (50, 0.0, 1.0), 2: (50, 0.0, 1.0)}, {0: (3, 1.0)}, 11)
    assert [(i, j) for i, j, _, _ in ring] == [(0, 0)]


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    none = voronoi.whole_vectors(spark.createDataFrame([], schema))
    assert voronoi.nearest(none, none).count() == 0
    one = voronoi.whole_vectors(spark.createDataFrame([(0, [1.0])], schema))
    assert voronoi.nearest(one, one).count() == 0
    two = voronoi.whole_vectors(spark.createDataFrame([(0, [1.0]), (3, [-0.0005])], schema))
    assert [tuple(r) for r in voronoi.nearest(two, two.where("vec_id = 0")).collect()] == [(0, 1, 3, -1024)]
