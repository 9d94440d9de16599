"""Steps, vocabularies, token tables, sequences and training examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batches, corpus, expand, steps as S
from ..operators.tokens import Tokens
from ..operators.vectors import embed_sequences, one_hot_states
from ..plans import card, jobs, ndjson
from ..session import fresh_path
from ..streaming.tokens import stream_tokens as token_stream
from . import views
from .features import stored_rows
from .registry import query
from .sql import CARD_IDS, CARD_OFFSETS, CARD_STEPS, CARD_TOKENS, ND_ALL, log_bucket, quoted, with_


def prepared(spark, sf):
    return card.preprocess_card(views.card(spark, sf), hash="md5")


def nd_prepared(spark, sf):
    return ndjson.preprocess_ndjson(stored_rows(spark, sf))


def nd_stored(spark, sf):
    """Stored transactions and steps fitted on all of them."""
    stored = stored_rows(spark, sf)
    fit_rows = ndjson.clean_ndjson(stored).withColumn("time_delta_s", F.lit(0.0))
    return stored, ndjson.ndjson_steps(hash="md5").fit(fit_rows)


def nd_fitted(spark, sf):
    """Prepared rows and the fitted steps."""
    stored, t = nd_stored(spark, sf)
    return ndjson.preprocess_ndjson(stored), t


def joined(col):
    c = F.col(col) if isinstance(col, str) else col
    return F.array_join(c.cast("array<string>"), " ")


# -- single steps ---------------------------------------------------------------------------


@query(with_("card_pre", "SELECT row_id, 'HOUR_' || lpad(least(hour, 20)::VARCHAR, 2, '0') AS token, least(hour, 20)::INT AS local_idx FROM card_pre"))
def tok_fixed(spark, sf):
    s = S.FixedStep("hour", "HOUR", lo=0, hi=20, pad=2)
    return card.clean_card(views.card(spark, sf)).select("row_id", s.token().alias("token"), s.index().alias("local_idx"))


@query(with_("card_idx", "SELECT row_id, " + ", ".join(f'{t} AS "tok_{n}", {i}::INT AS "idx_{n}"' for n, i, _, t in CARD_STEPS if n in ("CAT", "MCC", "CHIP", "STATE")) + " FROM card_idx"))
def tok_map(spark, sf):
    steps = [s for s in card.card_steps().steps if s.prefix in ("CAT", "MCC", "CHIP", "STATE")]
    c = card.clean_card(views.card(spark, sf))
    return c.select("row_id", *[e for s in steps for e in (s.token().alias(f"tok_{s.prefix}"), s.index().alias(f"idx_{s.prefix}"))])


@query(with_("card_idx", "SELECT row_id, 'MERCH_' || i_merch AS token FROM card_idx"))
def tok_hash(spark, sf):
    c = card.normalize_columns(views.card(spark, sf)).select("row_id", card.clean.merchant(F.col("merchant_name")).alias("m"))
    return c.select("row_id", S.HashStep("m", "MERCH", buckets=2000, hash="md5").token().alias("token"))


@query(with_("nd_all nd_all_edges", f"SELECT user_id, seq_order, {ND_ALL[0][1]} AS token FROM nd_all"))
def tok_bins(spark, sf):
    c = ndjson.clean_ndjson(stored_rows(spark, sf))
    t = Tokens((S.BinStep("amount", "AMT", bins=20),)).fit(c)
    return t.transform(c, keep=["user_id", "seq_order"]).withColumnRenamed("tok_AMT", "token")


@query(with_("nd_all", f"SELECT user_id, seq_order, 'TDIF_' || {log_bucket('time_delta_s')} AS token FROM nd_all"))
def tok_timedelta(spark, sf):
    s = S.TimeDeltaStep("time_delta_s", "TDIF")
    return nd_prepared(spark, sf).select("user_id", "seq_order", s.token().alias("token"))


@query(with_("card_pre", """
SELECT row_id, "user", card, amt_num, merch_hash::INT AS merch_hash, mcc_int, hour::INT AS hour, dow::INT AS dow, month::INT AS month,
  chip_upper, zip3, state_clean, cust::INT AS cust, time_delta_s, pos FROM card_pre
"""))
def preprocess_card(spark, sf):
    return prepared(spark, sf).select(
        "row_id", "user", "card", "amt_num", "merch_hash", "mcc_int", "hour", "dow", "month", "chip_upper",
        "zip3", "state_clean", "cust", "time_delta_s", "pos",
    )


@query(with_("nd_all", """
SELECT user_id, seq_order, amount, merch_name, issuer_addr, acq_bank, card_level, dow, period, round(time_delta_s, 6) AS time_delta_s, pos FROM nd_all
"""))
def preprocess_ndjson(spark, sf):
    return nd_prepared(spark, sf).select(
        "user_id", "seq_order", "amount", "merch_name", "issuer_addr", "acq_bank", "card_level", "dow", "period",
        F.round("time_delta_s", 6).alias("time_delta_s"), "pos",
    )


# -- step lists -------------------------------------------------------------------------------


@query(with_("card_idx", f"SELECT row_id, {CARD_TOKENS}, 'TDIF_' || {log_bucket('time_delta_s')} AS \"tok_TDIF\" FROM card_idx"))
def card_tokens(spark, sf):
    return card.fitted_card_steps(time_delta=True).transform(prepared(spark, sf), keep=["row_id"])


@query(with_("card_idx", f"SELECT row_id, {CARD_TOKENS} FROM card_idx"))
def transform_tokens(spark, sf):
    return card.fitted_card_steps().transform(card.clean_card(views.card(spark, sf), hash="md5"), keep=["row_id"])


@query(with_("nd_tok", "SELECT user_id, seq_order, " + ", ".join(f'"tok_{p}"' for p, _ in ND_ALL) + " FROM nd_tok"))
def ndjson_tokens(spark, sf):
    pre, t = nd_fitted(spark, sf)
    return t.transform(pre, keep=["user_id", "seq_order"])


@query(with_("card_idx", """SELECT row_id, 'HOUR_' || lpad(hour::VARCHAR, 2, '0') AS "tok_HOUR", 'BIG_' || (CASE WHEN amt_num >= 100 THEN 1 ELSE 0 END) AS "tok_BIG" FROM card_idx"""))
def add_step(spark, sf):
    t = Tokens(()).add_step(S.FixedStep("hour", "HOUR", hi=23, pad=2)).add_step(S.ThresholdStep("amt_num", "BIG", thresholds=(100.0,)))
    return t.fit().transform(card.clean_card(views.card(spark, sf)), keep=["row_id"])


@query(with_("nd_vocab", "SELECT local_idx, token, global_id FROM nd_vocab"))
def fit_vocab(spark, sf):
    _, t = nd_stored(spark, sf)
    return t.vocab(spark).select("local_idx", "token", "global_id")


@query(with_("nd_vocab", "SELECT 6251::BIGINT AS card_size, count(*) AS ndjson_size FROM nd_vocab"))
def vocab_size(spark, sf):
    _, t = nd_stored(spark, sf)
    n = t.vocab(spark).agg(F.count(F.lit(1)).alias("ndjson_size"))
    return n.select(F.lit(card.fitted_card_steps().vocab_size).cast("bigint").alias("card_size"), "ndjson_size")


# -- text ------------------------------------------------------------------------------------------


@query(with_("card_txt", "SELECT row_id, txn_text FROM card_txt"))
def txn_text(spark, sf):
    return card.fitted_card_steps().with_text(card.clean_card(views.card(spark, sf), hash="md5"), keep=["row_id"])


def card_seqs(spark, sf):
    return jobs.card_corpus(views.card(spark, sf), 5, hash="md5", split=False)[0]


@query(with_("card_seq", 'SELECT "user", card, chunk_id, text FROM card_seq'))
def sequence_text(spark, sf):
    return card_seqs(spark, sf).select("user", "card", "chunk_id", "text")


@query(with_("card_seq", 'SELECT "user", card, chunk_id, n_txns, text FROM card_seq'))
def to_corpus(spark, sf):
    return card_seqs(spark, sf).select("user", "card", "chunk_id", "n_txns", "text")


@query(with_("card_txt", """
SELECT "user", card, (pos // 5)::INT AS chunk_id, string_agg(txn_text, ' <sep> ' ORDER BY pos) AS txns FROM card_txt GROUP BY ALL
"""))
def collect_sequences(spark, sf):
    body = F.expr("substring(text, 7, length(text) - 12)")
    return card_seqs(spark, sf).select("user", "card", "chunk_id", body.alias("txns"))


@query(with_("split_seq", 'SELECT split, "user", card, chunk_id, n_txns, text FROM split_seq'))
def generate_corpus_card(spark, sf):
    seqs, _ = jobs.card_corpus(views.card(spark, sf), 5, hash="md5")
    return seqs.select("split", "user", "card", "chunk_id", "n_txns", "text")


def nd_seqs(spark, sf):
    return jobs.ndjson_corpus(stored_rows(spark, sf), 20, hash="md5")[0]


@query(with_("nd_seq", "SELECT split, user_id, chunk_id, n_txns, label, text FROM nd_seq"))
def generate_corpus_ndjson(spark, sf):
    return nd_seqs(spark, sf).select("split", "user_id", "chunk_id", "n_txns", "label", "text")


@query(with_("nd_tok", """
SELECT user_id, (pos // 20)::INT AS chunk_id, count(*) AS n_txns, max(label) AS label,
  '<bos> ' || string_agg(concat_ws(' ', """ + ", ".join(f'"tok_{p}"' for p, _ in ND_ALL) + """), ' <sep> ' ORDER BY pos) || ' <eos>' AS text
FROM nd_tok GROUP BY user_id, chunk_id
"""))
def to_corpus_with_meta(spark, sf):
    pre, t = nd_fitted(spark, sf)
    txt = t.with_text(pre, keep=["user_id", "label", "pos"])
    return corpus.to_sequences(txt, ["user_id"], [], 20, label="label", position="pos").select("user_id", "chunk_id", "n_txns", "label", "text")


@query(with_("nd_seq", "SELECT split, user_id, chunk_id, n_txns, label FROM nd_seq"))
def sequence_meta(spark, sf):
    return nd_seqs(spark, sf).select("split", "user_id", "chunk_id", "n_txns", "label")


# -- ids ---------------------------------------------------------------------------------------------


@query(with_("card_idx", f"SELECT row_id, array_to_string([1, {CARD_IDS}, 2, 0, 0], ' ') AS ids, array_to_string([1, {CARD_IDS}][:8], ' ') AS cut FROM card_idx"))
def encode_row(spark, sf):
    c = card.clean_card(views.card(spark, sf), hash="md5")
    t = card.fitted_card_steps()
    both = t.encode(t.encode(c, 16), 8, keep=["row_id", "input_ids"], name="cut")
    return both.select("row_id", joined("input_ids").alias("ids"), joined("cut").alias("cut"))


# Ids of a sequence: <bos>, rows separated by <sep>, <eos>.
CARD_SEQ_IDS = f"""
, r AS (SELECT "user", card, (pos // 5)::INT AS chunk_id, pos, array_to_string([{CARD_IDS}], ' ') AS ids FROM card_idx),
s AS (SELECT "user", card, chunk_id, '1 ' || string_agg(ids, ' 3 ' ORDER BY pos) || ' 2' AS ids, (13 * count(*) + 1)::INT AS n FROM r GROUP BY ALL)
"""


@query(with_("card_idx", CARD_SEQ_IDS + """SELECT "user", card, chunk_id, ids || repeat(' 0', 70 - n) AS ids FROM s"""))
def encode_text(spark, sf):
    e = card.fitted_card_steps().encode_text(card_seqs(spark, sf), max_length=70)
    return e.select("user", "card", "chunk_id", joined("input_ids").alias("ids"))


@query(with_("card_seq", 'SELECT "user", card, chunk_id, text FROM card_seq'))
def decode_ids(spark, sf):
    t = card.fitted_card_steps()
    e = t.encode_text(card_seqs(spark, sf), max_length=70).drop("text")
    return t.decode_ids(e).select("user", "card", "chunk_id", "text")


CLM = """SELECT "user", card, chunk_id, array_to_string((string_split(ids, ' ') || list_transform(range(70), lambda x: '0'))[:40], ' ') AS input_ids,
  array_to_string((string_split(ids, ' ') || list_transform(range(70), lambda x: '{pad}'))[:40], ' ') AS labels FROM s"""


@query(with_("card_idx", CARD_SEQ_IDS + CLM.format(pad="-100")))
def clm_example(spark, sf):
    t = card.fitted_card_steps()
    e = t.encode_text(card_seqs(spark, sf), name="token_ids").drop("text")
    c = corpus.clm_examples(e, length=40)
    return c.select("user", "card", "chunk_id", joined("input_ids").alias("input_ids"), joined("labels").alias("labels"))


@query(with_("card_idx", CARD_SEQ_IDS + CLM.format(pad="0")))
def clm_dataset(spark, sf):
    c = corpus.clm_dataset(card_seqs(spark, sf), card.fitted_card_steps(), 40, mask_pad=False)
    return c.select("user", "card", "chunk_id", joined("input_ids").alias("input_ids"), joined("labels").alias("labels"))


@query(with_("nd_ids", """
SELECT user_id, seq_order, array_to_string(ids || [0, 0], ' ') AS ids, '1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 0 0' AS mask, array_to_string(ids[:9] || [2], ' ') AS cut FROM nd_ids
"""))
def encode_txn(spark, sf):
    pre, t = nd_fitted(spark, sf)
    e = t.encode_txn(pre, 20)
    e = t.encode_txn(e, 10, keep=["user_id", "seq_order", "input_ids", "attention_mask"], name="cut", mask="cut_mask")
    return e.select("user_id", "seq_order", joined("input_ids").alias("ids"), joined("attention_mask").alias("mask"), joined("cut").alias("cut"))


SAMPLES = """
, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq_order DESC) AS back FROM nd_ids) WHERE back <= {n}),
g AS (SELECT *, floor(unix_ts)::BIGINT AS ts, greatest(coalesce(floor((floor(unix_ts)::BIGINT - lag(floor(unix_ts)::BIGINT) OVER (PARTITION BY user_id ORDER BY seq_order)) / 3600), 0), 0)::BIGINT AS h FROM last),
u AS (SELECT user_id, count(*)::INT AS lens_in, coalesce(max(label), 0)::INT AS label, arg_max(amount, seq_order) AS amount,
  string_agg(array_to_string(ids || list_transform(range(14), lambda x: 0), ' '), '|' ORDER BY seq_order) AS ids,
  string_agg(ts::VARCHAR, ' ' ORDER BY seq_order) AS times, string_agg(h::VARCHAR, ' ' ORDER BY seq_order) AS hours FROM g GROUP BY user_id)
"""


def nested(col):
    return F.array_join(F.transform(col, joined), "|")


@query(with_("nd_ids", SAMPLES.format(n=40) + "SELECT user_id, lens_in, label, amount, ids, times, hours FROM u"))
def sft_samples(spark, sf):
    stored, t = nd_stored(spark, sf)
    s = jobs.ndjson_samples(stored, t, 40)
    return s.select(
        "user_id", "lens_in", "label", "amount", nested("input_ids").alias("ids"), joined("his_time_stap").alias("times"),
        joined("delta_time_stap").alias("hours"),
    )


@query(with_("nd_ids", SAMPLES.format(n=90) + """
SELECT user_id, lens_in, label, amount, ids || repeat('|' || array_to_string(list_transform(range(32), lambda x: 0), ' '), 90 - lens_in) AS ids,
  array_to_string(list_transform(range(90), lambda i: (i < lens_in)::INT), ' ') AS step_mask, hours || repeat(' 0', 90 - lens_in) AS hours FROM u
"""))
def pad_history(spark, sf):
    stored, t = nd_stored(spark, sf)
    p = corpus.pad_history(jobs.ndjson_samples(stored, t, 90), 90)
    return p.select(
        "user_id", "lens_in", "label", "amount", nested("input_ids").alias("ids"), joined("step_mask").alias("step_mask"),
        joined("delta_time_stap").alias("hours"),
    )


BATCH_STEPS, BATCH_LONGEST = 4096, 512


@query(with_("v_rows", f"""
, u AS (SELECT user_id, least(count(*), {BATCH_LONGEST})::INT AS lens_in FROM v_rows GROUP BY user_id),
w AS (SELECT *, list_filter({batches.widths(BATCH_LONGEST)}, lambda x: x >= lens_in)[1]::INT AS width FROM u),
p AS (SELECT *, row_number() OVER (PARTITION BY width ORDER BY md5('42:0:' || user_id), user_id) - 1 AS pos, {BATCH_STEPS} // width AS cap FROM w)
SELECT user_id, lens_in, width, (pos // cap)::BIGINT AS batch, (pos % cap)::INT AS place, count(*) OVER b AS n, max(lens_in) OVER b AS pad_to,
  md5('42:0:' || width || ':' || (pos // cap)::BIGINT) AS batch_key FROM p WINDOW b AS (PARTITION BY width, pos // cap)
"""))
def pad_history_batches(spark, sf):
    """Batch and place of every user's history of up to 512 steps, 4,096 padded steps a batch."""
    lengths = stored_rows(spark, sf).groupBy("user_id").agg(F.least(F.count(F.lit(1)), F.lit(BATCH_LONGEST)).cast("int").alias("lens_in"))
    dealt = batches.assign_batches(lengths, "user_id", "lens_in", BATCH_STEPS, BATCH_LONGEST, hash="md5")
    out = batches.gather_batches(dealt, ["user_id", "lens_in"])
    return out.select("batch_key", "width", "batch", "n", "pad_to", F.inline("rows"))


# -- vectors from ids ------------------------------------------------------------------------------------


@query(with_("card_idx", f"""
, t AS (SELECT row_id, [1, {CARD_IDS}, 2] AS ids FROM card_idx)
SELECT row_id, array_to_string(list_transform(range(8), lambda j: printf('%.4f', len(list_filter(ids, lambda x: x % 8 = j)) / 14 + 0.0000001)), ' ') AS embedding FROM t
"""), name="embed_sequences")
def embed_sequences_(spark, sf):
    t = card.fitted_card_steps()
    e = embed_sequences(t.encode(card.clean_card(views.card(spark, sf), hash="md5"), 32, keep=["row_id"]), one_hot_states(8), pooling="mean")
    shown = F.transform("embedding", lambda x: F.format_string("%.4f", x.cast("double") + 0.0000001))
    return e.select("row_id", F.array_join(shown, " ").alias("embedding"))


@query(with_("v_split split_idx", f"""
, pool AS (SELECT row_id, split, ("Is Fraud?" IN ('Yes', '1'))::INT AS y FROM v_split),
q AS (SELECT least(sum(y), 100) AS p, sum(1 - y) AS n FROM pool WHERE split = 'train'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || row_id)) AS r FROM pool WHERE split = 'train'),
kept AS (SELECT row_id, split, y FROM ranked, q WHERE r <= CASE WHEN y = 1 THEN p ELSE least(n, 1000 - p) END
  UNION ALL SELECT row_id, split, y FROM pool WHERE split <> 'train')
SELECT kept.row_id, kept.split, y AS label, 16 AS dim, (list_last([1, {CARD_IDS}, 2]) % 16)::INT AS set_entry FROM kept JOIN split_idx USING (row_id)
"""))
def embed_all_splits(spark, sf):
    from ..operators.split import temporal_split_date

    s, _ = temporal_split_date(views.card(spark, sf))
    e = jobs.embed_splits(s, "card", load_model=one_hot_states(16), balanced_total=1000, hash="md5")
    # The one entry that is set tells the token whose state was taken: the last one, <eos>.
    at = (F.array_position("embedding", F.lit(1.0).cast("float")) - 1).cast("int")
    return e.select("row_id", "split", "label", F.size("embedding").alias("dim"), at.alias("set_entry"))


@query(with_("nd_tok", """
SELECT user_id, seq_order, concat_ws(' ', """ + ", ".join(f'"tok_{p}"' for p, _ in ND_ALL) + """) AS txn_text FROM nd_tok
"""))
def stream_tokens(spark, sf):
    """The record folder read as a stream with a frozen vocabulary, run until it is drained."""
    folder = views.record_folder(spark, sf)
    _, t = nd_stored(spark, sf)
    out, ck = fresh_path(spark, "streamed"), fresh_path(spark, "offsets")
    q = (
        token_stream(spark, folder, t, pattern="*.txt").writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema("user_id string, seq_order int, txn_text string").parquet(out)
