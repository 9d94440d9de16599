"""Prefix counts, token files and Elias-Fano sequences."""

import functools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import elias_fano, token_counts, token_files
from ledgerspark.llm.pieces_bpe import encoder, tokenizer_path
from ledgerspark.session import fresh_path

from .helpers import awkward_docs, no_docs

NAME = "word_bpe_49k.json"


@functools.cache
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def library_ids(texts, path):
    return [e.ids for e in library(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", [NAME, "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    path = tokenizer_path(name)
    r = random.Random(3)
    chars = "ab cS'tVE1²ª.!?-\n\t\r«ßéİ日  \u0085éŉ…’|<>"
    texts = ["".join(r.choice(chars) for _ in range(r.randint(0, 40))) for _ in range(600)] + ["it's 'S <|endoftext|>x<|startoftext|>", "  ", ""]
    got = [np.frombuffer(encoder(path).encode(t), "<u4").tolist() for t in texts]
    assert got == library_ids(texts, path)


def test_prefix_counts_are_those_of_the_prefixes(spark):
    path = tokenizer_path(NAME)
    rows = token_counts.prefix_counts(awkward_docs(spark), path).collect()
    texts = [r["text"] for r in awkward_docs(spark).collect()]
    ids = library_ids(texts, path)
    want = Counter((len((t or "").encode()), len(i)) for t, i in zip(texts, ids))
    assert Counter((r["n_bytes"], r["n_tokens"]) for r in rows) == want
    for t in ["Two words, it's 3 <b>", "İ é日 x", ""]:
        ends, counts = token_counts.prefix_table(encoder(path), t)
        for e, c in zip(ends.tolist(), counts.tolist()):
            assert c == len(library_ids([t.encode()[:e].decode()], path)[0])
    t = "some words, and then 42 more it's"
    ends, counts = token_counts.prefix_table(encoder(path), t)
    for cut in range(len(t) + 1):
        assert token_counts.count_at(encoder(path), t, ends, counts, cut) == len(library_ids([t[:cut]], path)[0])
    assert token_counts.prefix_counts(no_docs(spark), path).count() == 0


def test_every_prefix_has_its_count():
    """Each cut of odd texts, of runs without white space and of repetitive marks, against the library."""
    path, r = tokenizer_path(NAME), random.Random(11)
    enc = encoder(path)
    chars = "ab cS'tVE1²ª.!?-\n\t\r«ßéİ日本  \u0085éŉ…’|<>Ⱥ\u3000\u3000\x1c"
    texts = ["".join(r.choice(chars) for _ in range(r.randint(0, 40))) for _ in range(150)]
    texts += ["'re we're 's <|endoftext|>x<|startoftext|> ab<|endoftext<|endoftext|>", "=" * 60 + "-" * 40 + "''ve", "a" * 70]
    texts += ["".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(300)), "".join(r.choice("abehilnorst") for _ in range(300))]
    for t in texts:
        ends, counts = token_counts.prefix_table(enc, t)
        want = [len(i) for i in library_ids([t[:k] for k in range(len(t) + 1)], path)]
        at = [len(t[:k].encode()) for k in range(len(t) + 1)]
        assert [token_counts.count_at(enc, t, ends, counts, c) for c in at] == want, t
        budget = token_counts.budget_table(*token_counts._ends_and_counts(enc, t))
        cuts = [(c, n) for k, (c, n) in enumerate(zip(at, want)) if k == 0 or not t[k - 1].isspace() or t[k - 1] == "\x1c"]
        assert budget.tolist() == [max(c for c, n in cuts if n <= b) for b in range(want[-1] + 1)], t


def test_clusters_that_normalization_joins():
    path = tokenizer_path(NAME)
    enc, t = encoder(path), "xe\u0301te\u0301 \u1112\u1161\u11ab!"
    ends, counts = token_counts.prefix_table(enc, t)
    at = lambda k: token_counts.count_at(enc, t, ends, counts, len(t[:k].encode()))
    for k in (1, 3, 4, 6, 7, 10, 11):
        assert at(k) == len(library_ids([t[:k]], path)[0])
    assert at(2) == at(1) and at(9) == at(7)


def test_long_text_without_white_space():
    path, r = tokenizer_path(NAME), random.Random(12)
    for t in ("".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(20000)), "".join(r.choice("abehilnorst=") for _ in range(50000))):
        ends, counts = token_counts.prefix_table(encoder(path), t)
        for k in [1, 7, 2048, 9999, len(t) - 1, len(t)]:
            assert token_counts.count_at(encoder(path), t, ends, counts, len(t[:k].encode())) == len(library_ids([t[:k]], path)[0])


def test_lookups_in_columns_equal_the_library(spark):
    path = tokenizer_path(NAME)
    texts = ["Some words, and then 42 more it's", "日本語のテキスト" * 5, "", "  x", None]
    want = {}
    for i, t in enumerate(t or "" for t in texts):
        counts = [len(x) for x in library_ids([t[:k] for k in range(len(t) + 1)], path)]
        at = [len(t[:k].encode()) for k in range(len(t) + 1)]
        for x in range(-1, 40):
            within = [c for c, b in zip(counts, at) if b <= x]
            fit = [b for k, (c, b) in enumerate(zip(counts, at)) if c <= x and not t[:k].endswith(" ")]
            want[i, x] = (within[-1] if within else 0, max(fit, default=0))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = token_counts.prefix_counts(df, path).crossJoin(spark.range(-1, 40))
    got = out.select("doc_id", "id", token_counts.tokens_within(F.col("id")).alias("t"), token_counts.longest_within(F.col("id")).alias("b")).collect()
    assert {(r["doc_id"], r["id"]): (r["t"], r["b"]) for r in got} == want


def test_truncation_and_budget(spark):
    df = spark.createDataFrame([(1, "one two three four"), (2, "")], "doc_id long, text string")
    out = token_counts.prefix_counts(df, tokenizer_path(NAME)).select("doc_id", token_counts.tokens_within(8).alias("t"), token_counts.longest_within(3).alias("b"), token_counts.longest_within(0).alias("z"))
    got = {r["doc_id"]: (r["t"], r["b"], r["z"]) for r in out.collect()}
    assert got == {1: (2, 13, 0), 2: (0, 0, 0)}


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [1, 2, 3, 900, 900, 10**6], list(range(0, 3000, 7)), [2**40]])
def test_elias_fano(values):
    e = elias_fano.EliasFano(elias_fano.encode(values))
    assert e.all().tolist() == values and [e.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        e.select(len(values))
    if len(values) > 100:
        assert len(elias_fano.encode(values)) < 2 * len(values)


@pytest.mark.parametrize("block_ids", [50, token_files.BLOCK_IDS])
def test_token_files_round_trip(spark, block_ids):
    path, tok = fresh_path(spark, "tokens"), tokenizer_path(NAME)
    docs = awkward_docs(spark)
    token_files.write_tokens(docs, path, tok, block_ids=block_ids)
    rows = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    keyed = [r["doc_id"] for r in rows]
    assert keyed == sorted(keyed, key=lambda x: (x is not None, x))
    assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows]]).tolist()[:-1]
    source = docs.collect()
    want = Counter((r["doc_id"], len(i) + 1, zlib.crc32(np.array([*i, 2], "<u4").tobytes())) for r, i in zip(source, library_ids([r["text"] for r in source], tok)))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    block = spark.read.parquet(path).where(F.array_contains("names", 13)).first()
    text = next(r["text"] for r in source if r["doc_id"] == 13)
    assert token_files.document_ids(block, block["names"].index(13)).tolist() == [*library_ids([text], tok)[0], 2]


def test_token_files_of_no_documents_and_of_another_order(spark):
    path = fresh_path(spark, "tokens")
    token_files.write_tokens(no_docs(spark), path, tokenizer_path(NAME))
    assert token_files.read_tokens(spark, path).count() == 0
    path = fresh_path(spark, "tokens")
    token_files.write_tokens(awkward_docs(spark).where("doc_id IS NOT NULL"), path, tokenizer_path(NAME), order=[-F.col("doc_id")])
    rows = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in rows), reverse=True)
