"""The quality classifier: features, solver, held-out accuracy and awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import quality

from .helpers import awkward_docs, no_docs


def test_features_do_not_cross_texts():
    texts = [b"Ab cd!! 12", b"", b"cd!!", b"  \n", "é x".encode()]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    doc, bucket = quality.features(data, offsets)
    for i, t in enumerate(texts):
        alone = quality.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[1]
        assert bucket[doc == i].tolist() == alone.tolist()
    assert not (doc == 1).any() and not (doc == 3).any()


def test_solver_finds_the_margin():
    ids = [np.array([0, 2]), np.array([0]), np.array([1, 2]), np.array([1])] * 20
    label = np.array([1, 1, 0, 0] * 20)
    w, b = quality.dual_coordinate_descent(ids, label, np.array([1.0, -1.0, 0.1]), 1.0)
    ratio = np.array([1.0, -1.0, 0.1])
    for x, y in zip(ids, label):
        v = ratio[x] / np.sqrt(np.square(ratio[x]).sum())
        assert (w[x] @ v + b > 0) == (y == 1)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    right = [r["predicted"] == r["quality"] for r in out]
    assert len(right) > 50 and np.mean(right) > 0.95
    assert all(r["predicted"] == 1 for r in out if r["quality"] == 1 and r["score"] >= 0.5)


def test_held_out_labels_are_not_learned_from(spark):
    docs = awkward_docs(spark)
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(1, 18)], "doc_id long, quality int, text string")
    a = quality.fit(docs, labels)
    changed = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    b = quality.fit(docs, changed)
    assert np.array_equal(a.weight, b.weight) and a.bias == b.bias


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 0)], [(1, 1), (1, 0), (2, None), (None, 1), (3, 7), (12, 1), (15, 0), (4, 0), (5, 1)]])
def test_awkward_rows(spark, labels):
    docs = awkward_docs(spark)
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    rows = quality.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in rows)
    assert quality.score(no_docs(spark), model).count() == 0
