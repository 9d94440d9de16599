"""Steps, vocabularies and encodings."""

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import clean
from ledgerspark.operators import corpus, steps as S
from ledgerspark.operators.align import extract_label
from ledgerspark.operators.tokens import Tokens, fit_edges
from ledgerspark.plans import card, jobs, ndjson


@pytest.fixture(scope="module")
def flat(spark):
    rows = [
        (
            f"addr_{i % 5}", f"bank_{i % 3}", "普金白钻"[i % 4], f"saddr_{i % 4}", f"sbank_{i % 3}", f"code_{i % 5}", f"ch_{i % 3}", f"pos_{i % 4}",
            f"resp_{i % 6}", f"mcc_{i % 7}", "直间"[i % 2], f"商户名_{i}", str(i * 100 + 50), i % 7, i % 4, 1712067737.0 + i * 3600, "u1", i, 1,
        )
        for i in range(20)
    ]
    names = (
        "issuer_addr string, issuer_bank string, card_level string, acq_addr string, acq_bank string, txn_code string, channel string, pos_input string,"
        "resp_code string, merch_type string, conn_mode string, merch_name string, amount string, dow int, period int, unix_ts double, user_id string,"
        "seq_order int, label int"
    )
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="module")
def pre(flat):
    return ndjson.preprocess_ndjson(flat)


def test_full_cycle(pre):
    t = ndjson.ndjson_steps(buckets=100, name_buckets=200, amount="fixed").fit(pre)
    out = t.transform(pre)
    assert [c for c in out.columns if c.startswith("tok_")] == t.token_columns() and len(t.token_columns()) == 16
    assert {r["time_delta_s"] for r in out.collect()} == {0.0, 3600.0}
    # Amounts are compared with the thresholds, not clipped as they are.
    assert {r["tok_AMT"] for r in out.where("seq_order = 19").collect()} == {"AMT_5"}


def test_specials_and_text_round_trip(spark, pre, tmp_path):
    t = ndjson.ndjson_steps(buckets=100, amount="quantile").fit(pre)
    vocab = {r["token"]: r["global_id"] for r in t.vocab(spark).collect()}
    assert [vocab[x] for x in ("<pad>", "<bos>", "<eos>", "<sep>", "<unk>")] == list(range(5))
    assert len(vocab) == t.vocab_size and sorted(vocab.values()) == list(range(t.vocab_size))
    sample = "<bos> MERCH_NAME_17 PERIOD_2 <sep> AMT_3 DOW_6 <sep> AMT_0 <eos>"
    df = spark.createDataFrame([(sample,)], "text string")
    ids = t.encode_text(df).first()["input_ids"]
    assert ids == [vocab[w] for w in sample.split()] and ids[0] == 1 and ids[-1] == 2
    path = str(tmp_path / "vocab")
    t.save(spark, path)
    again = Tokens.load(spark, path)
    assert again == t and again.vocab_size == t.vocab_size
    assert again.encode_text(df).first()["input_ids"] == ids
    assert again.decode_ids(again.encode_text(df, max_length=12).drop("text")).first()["text"] == sample
    # The edges come back too, so new rows are binned as in training.
    assert [r[0] for r in again.transform(pre, ["seq_order"]).orderBy("seq_order").select("tok_AMT").collect()] == [
        r[0] for r in t.transform(pre, ["seq_order"]).orderBy("seq_order").select("tok_AMT").collect()
    ]


def test_every_token_has_its_rule_id(spark, pre):
    t = ndjson.ndjson_steps(buckets=30, amount="fixed").fit(pre)
    v = t.vocab(spark)
    bad = v.where(~t.id_of_token(F.col("token")).eqNullSafe(F.col("global_id")) | ~t.token_of_id(F.col("global_id")).eqNullSafe(F.col("token")))
    assert bad.count() == 0
    c = card.fitted_card_steps()
    v = c.vocab(spark)
    assert v.count() == 6251 == c.vocab_size
    assert v.where(c.id_of_token(F.col("token")) != F.col("global_id")).count() == 0


@pytest.mark.parametrize("text", ["HOUR_7", "HOUR_007", "HOUR_24", "AMT_", "AMT_7", "AMT_-1", "MONTH_00", "ZIP3_1000", "XYZ_1", "_", "AMT", "CHIP_", "MCC_12", "AMT_ 1"])
def test_unknown_tokens(spark, text):
    t = card.fitted_card_steps()
    assert spark.range(1).select(t.id_of_token(F.lit(text))).first()[0] == 4


def test_unseen_category_is_unk(spark):
    train = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    t = Tokens((S.MapStep("c", "C"),)).fit(train)
    new = spark.createDataFrame([("a",), ("zz",), (None,)], "c string")
    assert [r["tok_C"] for r in t.transform(new).collect()] == ["C_a", "C_UNK", "C_UNK"]
    assert t.vocab_size == 8


@pytest.mark.parametrize("literal,collect", [(512, 100_000), (3, 100_000), (3, 4)])
def test_long_label_lists_give_the_same_ids(spark, monkeypatch, tmp_path, literal, collect):
    monkeypatch.setattr(S, "LITERAL_LABELS", literal)
    monkeypatch.setattr(S, "COLLECT_LABELS", collect)
    df = spark.createDataFrame([(f"v{i % 9}", i) for i in range(40)] + [(None, 99)], "c string, i int")
    t = Tokens((S.MapStep("c", "C"), S.FixedStep("i", "I", lo=0, hi=50))).fit(df.where("i < 30"))
    assert t.steps[0].joined == (literal == 3) and (t.steps[0].table is not None) == (collect == 4)
    t.save(spark, str(tmp_path / "v"))
    for x in (t, Tokens.load(spark, str(tmp_path / "v"))):
        vocab = {r["token"]: r["global_id"] for r in x.vocab(spark).collect()}
        both = x.encode(x.transform(df), 6).collect()
        assert len(both) == 41 and x.vocab_size == 5 + 10 + 51
        for r in both:
            assert r["tok_C"] == (f"C_{r['c']}" if r["c"] else "C_UNK")
            assert r["input_ids"] == [1, vocab[r["tok_C"]], vocab[r["tok_I"]], 2, 0, 0]
        lines = spark.createDataFrame(
            [(1, "<bos> C_v3 I_7 <sep> C_v0 C_UNK C_zz I_99 <eos>", "x"), (2, "C_v3", "y"), (3, "  ", "z")], "k int, text string, other string"
        )
        want = {1: [1, vocab["C_v3"], vocab["I_7"], 3, vocab["C_v0"], vocab["C_UNK"], 4, 4, 2, 0], 2: [vocab["C_v3"], *[0] * 9], 3: [0] * 10}
        e = x.encode_text(lines, max_length=10, keys=["k"])
        assert {r["k"]: r["input_ids"] for r in e.collect()} == want and {r["other"] for r in e.collect()} == {"x", "y", "z"}
        text = {r["k"]: r["text"] for r in x.decode_ids(e.drop("text"), keys=["k"]).collect()}
        assert text == {1: "<bos> C_v3 I_7 <sep> C_v0 C_UNK <unk> <unk> <eos>", 2: "C_v3", 3: ""}
        # Without keys the rows get one of their own.
        assert sorted(map(tuple, x.encode_text(lines, max_length=10).select("k", "input_ids").collect())) == sorted((k, v) for k, v in want.items())
        one = spark.createDataFrame([(w,) for w in ["C_v3", "C_UNK", "C_zz", "I_7", "<sep>", None]], "w string")
        assert {r["w"]: r["id"] for r in x.with_ids(one, "w").collect()} == {"C_v3": vocab["C_v3"], "C_UNK": vocab["C_UNK"], "C_zz": 4, "I_7": vocab["I_7"], "<sep>": 3, None: 4}
        clm = corpus.clm_dataset(lines, x, 10).orderBy("k").collect()
        assert [r["input_ids"] for r in clm] == [want[1], want[2], want[3]]


@pytest.mark.parametrize("collect", [100_000, 1])
def test_a_label_equal_to_the_default_keeps_its_place(spark, monkeypatch, collect):
    monkeypatch.setattr(S, "LITERAL_LABELS", 1)
    monkeypatch.setattr(S, "COLLECT_LABELS", collect)
    df = spark.createDataFrame([("Z",), ("UNK",), ("A",), (None,)], "c string")
    t = Tokens((S.MapStep("c", "C"),)).fit(df)
    new = spark.createDataFrame([("A",), ("Z",), ("UNK",), ("new",), (None,)], "c string")
    got = {r["c"]: r["input_ids"] for r in t.encode(new, 1, add_special=False).collect()}
    assert got == {"A": [5], "UNK": [6], "Z": [7], "new": [6], None: [6]}
    text = spark.createDataFrame([("C_A C_UNK C_Z C_new",)], "text string")
    assert t.encode_text(text).first()["input_ids"] == [5, 6, 7, 4]


def test_errors(spark, pre):
    steps = ndjson.ndjson_steps()
    with pytest.raises(ValueError, match="fit"):
        steps.transform(pre)
    with pytest.raises(ValueError, match="not found"):
        steps.fit(pre.drop("channel"))
    with pytest.raises(ValueError, match="fitted on data"):
        steps.fit()
    with pytest.raises(ValueError, match="unknown amount strategy"):
        ndjson.ndjson_steps(amount="deciles")
    with pytest.raises(ValueError, match="unknown route"):
        jobs.route("paper")


def test_no_python_and_one_shuffle(spark, pre, sf):
    from ledgerspark.queries import views

    seqs, _ = jobs.card_corpus(views.card(spark, sf).drop("nothing"), 5, split=False)
    plan = seqs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan and "ArrowEval" not in plan


@pytest.mark.parametrize("strategy", ["quantile", "uniform", "kmeans"])
def test_edges(spark, strategy):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    e = fit_edges(df, "x", 4, strategy)
    assert len(e) == 5 and e == sorted(e) and e[0] == 0.0 and e[-1] == 100.0
    if strategy != "kmeans":
        assert e == [0.0, 25.0, 50.0, 75.0, 100.0]
    got = [r[0] for r in df.select(clean.digitize(F.col("x"), e)).collect()]
    assert got == sorted(got) and set(got) == {0, 1, 2, 3}


def test_digitize_and_time_buckets(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (0.0,), (9.999999999,), (10.0,), (99.0,)], "x double")
    long = [float(i) for i in range(0, 1000, 10)]
    for edges in ([0.0, 10.0, 20.0], long):
        assert [r[0] for r in df.select(clean.digitize(F.col("x"), edges)).collect()][:5] == [0, 0, 0, 1, 1]
    t = spark.createDataFrame([(0.0,), (3600.0,), (1e12,), (None,), (-3.0,)], "s double")
    assert [r[0] for r in t.select(clean.log_time_bucket(F.col("s"))).collect()] == [1, 14, 31, 31, 1]


def test_card_cleaning_edges(spark):
    rows = [
        (1, 7, 12, 2020, 2, 30, "10:15", "$1,234.50", "Swipe Transaction", "Café #9!", None, "  ", "2139.0", None),
        (2, 9999, -1, None, None, 5, None, "$-12.00", "weird", None, None, "ca", None, 5411),
        (3, 7, 0, 2024, 4, 2, "9:5", "", "Online Transaction", "A-B c", None, "ONLINE", "7.0", 9999),
        (4, 7, 0, 2024, 13, 40, "25:00", "x", "Chip Transaction", "", None, None, "12345", 10000),
    ]
    names = "row_id long, User long, Card int, Year int, Month int, Day int, Time string, Amount string, `Use Chip` string, `Merchant Name` string, `Merchant City` string, `Merchant State` string, Zip string, MCC int"
    got = {r["row_id"]: r for r in card.clean_card(spark.createDataFrame(rows, names)).collect()}
    assert (got[1]["amt_num"], got[1]["card"], got[1]["zip3"], got[1]["state_clean"], got[1]["mcc_int"]) == (1234.5, 9, 213, "XX", -1)
    assert (got[1]["hour"], got[1]["dow"], got[1]["month"], got[1]["time_s"]) == (0, 0, 1, None)
    assert (got[2]["cust"], got[2]["card"], got[2]["merch_hash"], got[2]["zip3"], got[2]["state_clean"]) == (2999, 0, 0, 0, "CA")
    assert (got[3]["hour"], got[3]["dow"], got[3]["month"], got[3]["amt_num"], got[3]["zip3"]) == (9, 1, 4, None, 7)
    assert got[4]["time_s"] is None and got[4]["amt_num"] is None and got[4]["zip3"] == 123
    toks = {r["row_id"]: r for r in card.fitted_card_steps().transform(card.clean_card(spark.createDataFrame(rows, names))).collect()}
    assert (toks[1]["tok_AMT"], toks[2]["tok_AMT"], toks[4]["tok_AMT"]) == ("AMT_5", "AMT_0", "AMT_0")
    assert (toks[1]["tok_CAT"], toks[3]["tok_CAT"], toks[4]["tok_CAT"]) == ("CAT_GENERAL", "CAT_GOVERNMENT", "CAT_GENERAL")
    assert (toks[2]["tok_CHIP"], toks[3]["tok_MCC"], toks[3]["tok_HOUR"]) == ("CHIP_UNK", "MCC_-1", "HOUR_09")


@pytest.mark.parametrize("n,chunks", [(1, [1]), (5, [5]), (6, [5, 1]), (11, [5, 5, 1])])
def test_chunk_lengths(spark, n, chunks):
    df = spark.createDataFrame([("u", i, f"t{i}") for i in range(n)], "user string, i int, txn_text string")
    got = corpus.to_sequences(df, ["user"], [F.col("i")], 5).orderBy("chunk_id").collect()
    assert [r["n_txns"] for r in got] == chunks
    assert got[0]["text"] == "<bos> " + " <sep> ".join(f"t{i}" for i in range(chunks[0])) + " <eos>"


def test_sequences_of_a_large_key_are_the_same(spark):
    df = spark.createDataFrame([("u" if i % 3 else f"v{i}", i, f"t{i}") for i in range(400)], "user string, i int, txn_text string")
    a, b = (
        {tuple(r) for r in corpus.to_sequences(df, ["user"], [F.col("i")], 7, hot_rows=h).collect()} for h in (20, 10**6)
    )
    assert a == b


def test_copies_of_a_record_are_cut_into_parts(spark, flat):
    copies = flat.where("seq_order < 2").crossJoin(spark.range(60)).withColumn("row_id", F.monotonically_increasing_id())
    a, b = (
        sorted((r["pos"], r["time_delta_s"]) for r in ndjson.preprocess_ndjson(copies, hot_rows=h).collect()) for h in (25, 10**6)
    )
    assert a == b and [p for p, _ in a] == list(range(120)) and sum(d for _, d in a) == 3600.0


def test_group_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "cust int, Card int, x int")
    assert corpus.group_columns(df) == ["cust", "Card"]
    assert corpus.group_columns(df.select("x")) == ["x"]


def test_label_choice(spark):
    df = spark.createDataFrame([(0, "No"), (1, "Yes"), (1, "No")], "label int, `Is Fraud?` string")
    assert [r[0] for r in df.select(extract_label(df, "label")).collect()] == [0, 1, 1]
    assert [r[0] for r in df.select(extract_label(df)).collect()] == [0, 1, 0]
    assert extract_label(df.select(F.lit(1).alias("z"))) is None


def test_encode_limits(spark, flat):
    c = spark.createDataFrame([(3, 4)], "a int, b int")
    t = Tokens((S.FixedStep("a", "A", hi=9), S.FixedStep("b", "B", hi=9))).fit()
    ids = lambda **k: t.encode(c, **k).first()["input_ids"]
    assert ids(max_length=6) == [1, 8, 19, 2, 0, 0]
    assert ids(max_length=3) == [1, 8, 19]
    assert ids(max_length=1) == [1]
    assert ids(max_length=3, add_special=False) == [8, 19, 0]
    e = t.encode_txn(c, 3).first()
    assert e["input_ids"] == [1, 8, 2] and e["attention_mask"] == [1, 1, 1]


def test_padded_histories(spark):
    lens = [3, 5, 2, 4]
    rows = [(f"u{k}", i, 1000.0 + 7200 * i, float(i), k % 2, i % 3) for k, n in enumerate(lens) for i in range(n)]
    df = spark.createDataFrame(rows, "user_id string, seq_order int, unix_ts double, amount double, label int, a int")
    t = Tokens((S.FixedStep("a", "A", hi=3),)).fit()
    s = corpus.sft_samples(df, t, max_txn_len=6)
    p = {r["user_id"]: r for r in corpus.pad_history(s, 5, 6).collect()}
    assert [p[f"u{k}"]["lens_in"] for k in range(4)] == lens
    for k, n in enumerate(lens):
        r = p[f"u{k}"]
        assert len(r["input_ids"]) == 5 and all(len(x) == 6 for x in r["input_ids"])
        assert r["step_mask"] == [1] * n + [0] * (5 - n)
        assert r["delta_time_stap"] == [0] + [2] * (n - 1) + [0] * (5 - n)
        assert r["amount"] == n - 1 and r["label"] == k % 2
    cut = {r["user_id"]: r for r in corpus.sft_samples(df, t, max_txn_len=6, window=2, min_length=3).collect()}
    assert set(cut) == {"u0", "u1", "u3"} and cut["u1"]["his_time_stap"] == [22600, 29800] and cut["u1"]["delta_time_stap"] == [0, 2]


def test_clm_masks(spark):
    df = spark.createDataFrame([([5, 6, 7],)], "token_ids array<int>")
    r = corpus.clm_examples(df, length=5).first()
    assert (r["input_ids"], r["labels"]) == ([5, 6, 7, 0, 0], [5, 6, 7, -100, -100])
    assert corpus.clm_examples(df, length=5, mask_pad=False).first()["labels"] == [5, 6, 7, 0, 0]
    assert corpus.clm_examples(df, length=2).first()["labels"] == [5, 6]
