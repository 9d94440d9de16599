"""The pipeline against its stages by brute force, and the registered queries."""

import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from ledgerspark.llm import quality
from ledgerspark.llm.pieces_bpe import tokenizer_path
from ledgerspark.llm.queries import QUERIES
from tests.oracle import tables

from .test_decontaminate import brute as contaminated
from .test_near import brute_classes
from .test_tokens import library_ids


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_pipeline(spark, sf):
    con = tables(sf)
    docs = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(frame, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r["doc_id"] for r in quality.score(frame, model).where("predicted = 1").collect()}
    classes = brute_classes([(i, t) for i, t in docs.items() if i in good])
    heads = set(classes.values())
    bad = contaminated([(i, docs[i]) for i in heads], con.execute("SELECT item_id, text FROM benchmark").fetchall())
    want = {i for i in heads if not bad[i][3]}
    rows = sorted(corpus_pipeline.run(spark, sf).collect(), key=lambda r: r["start"])
    assert Counter(r["doc_id"] for r in rows) == Counter(want)
    ids = library_ids([docs[r["doc_id"]] for r in rows], tokenizer_path(corpus_pipeline.TOKENIZER))
    assert [r["n_tokens"] for r in rows] == [len(i) + 1 for i in ids]
    assert [r["ids_crc32"] for r in rows] == [zlib.crc32(np.array([*i, 2], "<u4").tobytes()) for i in ids]
    assert [r["start"] for r in rows] == np.cumsum([0, *[len(i) + 1 for i in ids]]).tolist()[:-1]
    # The mix decides the order of the files, not the ids.
    assert [r["doc_id"] for r in rows] != sorted(r["doc_id"] for r in rows)


@pytest.mark.parametrize("name", ["quality_classifier", "near_duplicates", "decontamination", "source_mix"])
def test_stages_keep_the_columns_and_take_no_rows(spark, sf, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    out = stage(spark, docs, sf)
    assert out.columns == docs.columns and out.count() == 0


def test_token_stage_takes_no_rows(spark, sf):
    assert corpus_pipeline.token_output(spark, spark.read.parquet(f"{sf}/documents.parquet").limit(0), sf).count() == 0
