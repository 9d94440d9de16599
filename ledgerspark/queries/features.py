"""Projections, predicates, scalar rules, lookups and keyed joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean
from ..functions.constants import CARD_FEATURES, CHIP_MAPPING, INDUSTRY_RANGES
from ..operators import align, expand, history, ml, ranges, steps as S
from ..operators.metrics import predictions, softmax_p1
from ..operators.pairwise import pair_summary
from ..operators.sampling import stratified_subsample
from ..operators.split import temporal_split_date, with_date
from ..operators.vectors import frequency_encode, pool, user_pool
from ..plans import card, ndjson
from ..session import fresh_path, materialize
from . import views
from .registry import query
from .sql import CARD_OFFSETS, CARD_STEPS, CAT_CASE, DISPLAY_CASE, bucket, log_bucket, with_


def rows(spark, sf):
    return expand.expand_records(views.records(spark, sf))


def stored_rows(spark, sf):
    """The same, written once, for queries that read them several times."""
    return materialize(rows(spark, sf), "transactions")


# -- projections and filters ----------------------------------------------------------


@query(with_("v_rows", "SELECT user_id, label, seq_order, unix_ts, merch_name, amount FROM v_rows"))
def expand_txns(spark, sf):
    return rows(spark, sf).select("user_id", "label", "seq_order", "unix_ts", "merch_name", "amount")


@query(with_("v_txn", """
SELECT user_id, seq_order, issuer_addr AS "cups_发卡机构地址", year, month, day, hour, minutes, seconds, unix_ts AS unix_timestap,
  conn_mode AS "cups_连接方式", amount AS "cups_交易金额" FROM v_txn
"""))
def positional_to_columns(spark, sf):
    named = expand.source_names(rows(spark, sf)).withColumnRenamed("cert_sm3", "user_id")
    return named.select(
        "user_id", "seq_order", "cups_发卡机构地址", "year", "month", "day", "hour", "minutes", "seconds", "unix_timestap",
        "cups_连接方式", "cups_交易金额",
    )


@query(with_("v_txn", """
SELECT count(*) FILTER (unix_ts::BIGINT % 2 = 0) AS n_short, count(*) FILTER (unix_ts::BIGINT % 2 = 1) AS n_kept
FROM (SELECT floor(unix_ts) AS unix_ts FROM v_txn)
"""))
def validate_arity(spark, sf):
    second = lambda t: F.floor(F.get(t, 9).cast("double"))
    cut = views.records(spark, sf).withColumn(
        "trans", F.transform("trans", lambda t: F.when(second(t) % 2 == 0, F.slice(t, 1, 12)).otherwise(t))
    )
    short = expand.short_transactions(cut).select(F.lit(1).alias("short"))
    kept = expand.expand_records(cut, strict=False).select(F.lit(0).alias("short"))
    return short.unionByName(kept).agg(F.count_if(F.col("short") == 1).alias("n_short"), F.count_if(F.col("short") == 0).alias("n_kept"))


@query(with_("v_rows", """
, t AS (SELECT *, CASE WHEN floor(unix_ts)::BIGINT % 2 = 0 THEN 'short' ELSE 'kept' END AS status FROM v_rows)
SELECT status, count(*) AS n_counted, count(*) AS n_stored, sum(seq_order)::BIGINT AS places,
  coalesce(sum(CASE WHEN status = 'kept' THEN replace(amount, ',', '')::BIGINT END), 0)::BIGINT AS amounts FROM t GROUP BY status
UNION ALL SELECT 'empty', 1, 1, 0, 0
"""))
def validate_arity_routed(spark, sf):
    """Good rows, rejects and counts of one pass: what was counted on the way, and what lies there."""
    second = lambda t: F.floor(F.get(t, 9).cast("double"))
    cut = views.records(spark, sf).withColumn(
        "trans", F.transform("trans", lambda t: F.when(second(t) % 2 == 0, F.slice(t, 1, 12)).otherwise(t))
    )
    path = fresh_path(spark, "routed")
    counts = expand.route_records(cut, path)
    listed = F.create_map(*[x for s, n in counts.items() for x in (F.lit(s), F.lit(n).cast("bigint"))])
    amount = F.regexp_replace("amount", ",", "").cast("bigint")
    return spark.read.parquet(path).groupBy(F.col("status").cast("string").alias("status")).agg(
        F.count(F.lit(1)).alias("n_stored"), F.coalesce(F.sum(F.col("seq_order").cast("bigint")), F.lit(0)).alias("places"),
        F.coalesce(F.sum(amount), F.lit(0)).alias("amounts"),
    ).withColumn("n_counted", listed[F.col("status")])


@query(with_("v_rows", "SELECT user_id, seq_order, dow, period, 19::INT AS n_columns FROM v_rows"))
def drop_time_cols(spark, sf):
    d = expand.expand_records(views.records(spark, sf), drop_time_columns=True)
    return d.select("user_id", "seq_order", "dow", "period", F.lit(len(d.columns)).alias("n_columns"))


@query(with_("v_card", 'SELECT row_id, "Use Chip" AS use_chip, "Is Fraud?" AS "is_fraud?", "Merchant City" AS merchant_city FROM v_card'))
def normalize_columns(spark, sf):
    return card.normalize_columns(views.card(spark, sf)).select("row_id", "use_chip", "is_fraud?", "merchant_city")


@query(with_("v_card", """
SELECT "User", "Card", "Year", "Month", "Day", split_part("Time", ':', 1)::INT AS "Hour", replace(replace("Amount", '$', ''), ',', '')::DOUBLE AS "Amount",
 "Use Chip", "Merchant Name", "Merchant City", "Merchant State", "Zip", "MCC" FROM v_card
"""))
def select_features(spark, sf):
    return card.engineer_features(views.card(spark, sf)).select(*[F.col(f"`{c}`") for c in CARD_FEATURES])


@query(with_("v_card", """
SELECT row_id, split_part("Time", ':', 1)::INT AS hour, replace(replace("Amount", '$', ''), ',', '')::DOUBLE AS amount,
  ("Is Fraud?" IN ('Yes', '1'))::INT AS target FROM v_card
"""))
def engineer_features(spark, sf):
    return card.engineer_features(views.card(spark, sf)).select(
        "row_id", F.col("Hour").alias("hour"), F.col("Amount").alias("amount"), F.col("_target").alias("target")
    )


@query(with_("v_card", """SELECT row_id, ("Is Fraud?" IN ('Yes', '1'))::INT AS target FROM v_card"""))
def make_target(spark, sf):
    return views.card(spark, sf).select("row_id", clean.target(F.col("`Is Fraud?`")).alias("target"))


@query(with_("v_card", """
SELECT row_id, ("Is Fraud?" IN ('Yes', '1'))::INT AS by_default, (row_id % 3 = 0)::INT AS by_preference FROM v_card
"""))
def extract_labels(spark, sf):
    c = views.card(spark, sf).withColumn("label", (F.col("row_id") % 3 == 0).cast("int"))
    return c.select("row_id", align.extract_label(c).alias("by_default"), align.extract_label(c, "label").alias("by_preference"))


@query(with_("v_txn", "SELECT user_id, count(*) AS n_rows, count(label) AS n_labelled, min(label) AS lo, max(label) AS hi FROM v_txn GROUP BY user_id"))
def broadcast_user_label(spark, sf):
    return rows(spark, sf).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("label").alias("n_labelled"), F.min("label").alias("lo"), F.max("label").alias("hi")
    )


@query(with_("v_txn", "SELECT amount FROM v_txn"))
def amount_series(spark, sf):
    return expand.amount_series(rows(spark, sf))


@query(with_("v_txn", "SELECT user_id, count(*)::INT AS n_txns FROM v_txn GROUP BY user_id HAVING count(*) >= 60"))
def min_history(spark, sf):
    kept = history.min_history(views.records(spark, sf), 60)
    return kept.groupBy(F.col("cert_sm3").alias("user_id")).agg(F.sum(F.size("trans")).cast("int").alias("n_txns"))


@query(with_("v_dated v_split", """
SELECT v_split.split, count(*) AS n_rows, (SELECT count(*) FROM v_dated WHERE date IS NULL) AS n_dropped FROM v_split GROUP BY v_split.split
"""))
def split_predicates(spark, sf):
    c = with_date(views.card(spark, sf))
    s, _ = temporal_split_date(c)
    dropped = c.agg(F.count_if(F.col("date").isNull()).alias("n_dropped"), F.lit(1).alias("j"))
    n = s.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("j", F.lit(1))
    return n.join(dropped, "j").drop("j")


@query(with_("card_idx", """
SELECT row_id, concat_ws(' ', coalesce(CASE WHEN amt_num >= 0 THEN 'AMT_' || i_amt END, '<unk>'), 'HOUR_' || lpad(i_hour::VARCHAR, 2, '0')) AS txn_text FROM card_idx
"""))
def fill_unk(spark, sf):
    c = card.clean_card(views.card(spark, sf))
    tok = c.select(
        "row_id",
        F.when(F.col("amt_num") >= 0, clean.format_token("AMT", clean.amount_bucket(F.col("amt_num")))).alias("a"),
        clean.format_token("HOUR", F.col("hour"), 2).alias("h"),
    )
    return tok.select("row_id", F.concat_ws(" ", F.coalesce("a", F.lit("<unk>")), F.coalesce("h", F.lit("<unk>"))).alias("txn_text"))


# -- scalar rules -----------------------------------------------------------------------


@query(with_("v_card", """SELECT row_id, replace(replace("Amount", '$', ''), ',', '')::DOUBLE AS amount FROM v_card"""))
def clean_amount_feature(spark, sf):
    return views.card(spark, sf).select("row_id", clean.amount_feature(F.col("Amount")).alias("amount"))


@query(with_("v_card", """
SELECT row_id, replace(replace("Amount", '$', ''), ',', '')::DOUBLE AS both, TRY_CAST(replace("Amount", '$', '') AS DOUBLE) AS dollar_only FROM v_card
"""))
def clean_amount_token(spark, sf):
    a = F.col("Amount")
    return views.card(spark, sf).select("row_id", clean.amount_number(a).alias("both"), clean.amount_number(a, "$").alias("dollar_only"))


@query(with_("card_idx", "SELECT row_id, i_amt::INT AS bucket FROM card_idx"))
def amount_bucket_fixed(spark, sf):
    return views.card(spark, sf).select("row_id", clean.amount_bucket(clean.amount_number(F.col("Amount"))).alias("bucket"))


@query(with_("card_clean", "SELECT row_id, merch_clean FROM card_clean"))
def clean_merchant(spark, sf):
    return views.card(spark, sf).select("row_id", clean.merchant(F.col("Merchant Name")).alias("merch_clean"))


@query(with_("nd_all", "SELECT user_id, seq_order, merch_name FROM nd_all"))
def clean_merchant_cjk(spark, sf):
    return rows(spark, sf).select("user_id", "seq_order", clean.merchant_cjk(F.col("merch_name")).alias("merch_name"))


@query(with_("nd_all", "SELECT user_id, seq_order, issuer_addr, acq_bank FROM nd_all"))
def clean_institution(spark, sf):
    return rows(spark, sf).select(
        "user_id", "seq_order", clean.institution(F.col("issuer_addr")).alias("issuer_addr"),
        clean.institution(F.col("acq_bank")).alias("acq_bank"),
    )


@query(with_("v_card", 'SELECT row_id, "MCC"::VARCHAR AS mcc, "Card"::VARCHAR AS card FROM v_card'))
def to_category_string(spark, sf):
    return views.card(spark, sf).select("row_id", F.col("MCC").cast("string").alias("mcc"), F.col("Card").cast("string").alias("card"))


@query(with_("v_card", f"""SELECT row_id, ({bucket('"Merchant State"', 100)})::INT AS state_bucket, ({bucket('"Merchant Name"', 2000)})::INT AS name_bucket FROM v_card"""))
def hash_bucket(spark, sf):
    return views.card(spark, sf).select(
        "row_id", clean.hash_bucket(F.col("Merchant State"), 100, "md5").alias("state_bucket"),
        clean.hash_bucket(F.col("Merchant Name"), 2000, "md5").alias("name_bucket"),
    )


@query(with_("v_card", """SELECT row_id, coalesce("MCC", -1) AS mcc_int, coalesce("MCC", -1)::VARCHAR AS mcc_str FROM v_card"""))
def mcc_norm(spark, sf):
    m = clean.mcc_int(F.col("MCC"))
    return views.card(spark, sf).select("row_id", m.alias("mcc_int"), m.cast("string").alias("mcc_str"))


@query(with_("v_dated", "SELECT row_id, date::VARCHAR AS date FROM v_dated"))
def date_from_parts(spark, sf):
    return with_date(views.card(spark, sf)).select("row_id", F.col("date").cast("string").alias("date"))


@query(with_("card_clean", "SELECT row_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM card_clean"))
def ts_from_parts(spark, sf):
    t = clean.timestamp_from_parts(F.col("Year"), F.col("Month"), F.col("Day"), F.col("Time"))
    return views.card(spark, sf).select("row_id", F.date_format(t, "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query(with_("card_pre", "SELECT row_id, hour::INT AS hour, dow::INT AS dow, month::INT AS month FROM card_pre"))
def hour_dow_month(spark, sf):
    return card.clean_card(views.card(spark, sf)).select("row_id", "hour", "dow", "month")


@query(with_("v_card", """
SELECT row_id, coalesce(isodow(TRY_CAST("Year" || '-' || "Month" || '-' || "Day" AS DATE)) - 1, 0)::INT AS dow FROM v_card
"""))
def weekday_from_parts(spark, sf):
    return views.card(spark, sf).select(
        "row_id", clean.weekday_from_parts(F.col("Year"), F.col("Month"), F.col("Day")).cast("int").alias("dow")
    )


@query(with_("v_rows", "SELECT user_id, seq_order, period FROM v_rows"))
def day_quarter(spark, sf):
    return rows(spark, sf).select("user_id", "seq_order", clean.day_quarter(F.col("hour"), F.col("minutes"), F.col("seconds")).alias("period"))


@query(with_("card_clean", "SELECT row_id, zip3 FROM card_clean"))
def zip3(spark, sf):
    return views.card(spark, sf).select("row_id", clean.zip3(F.col("Zip")).alias("zip3"))


@query(with_("card_clean", "SELECT row_id, state_clean FROM card_clean"))
def state_clean(spark, sf):
    return views.card(spark, sf).select("row_id", clean.state(F.col("Merchant State")).alias("state_clean"))


@query(with_("v_card", 'SELECT row_id, greatest(least("User", 900), 100)::BIGINT AS clipped FROM v_card'))
def clip(spark, sf):
    return views.card(spark, sf).select("row_id", clean.clip(F.col("User"), 100, 900).alias("clipped"))


@query(with_("v_card", """
SELECT row_id, 'HOUR_' || CASE WHEN "User" < 10 THEN lpad("User"::VARCHAR, 2, '0') ELSE "User"::VARCHAR END AS token FROM v_card
"""))
def token_format(spark, sf):
    return views.card(spark, sf).select("row_id", clean.format_token("HOUR", F.col("User"), 2).alias("token"))


@query(with_("card_clean", """
SELECT row_id, (CASE WHEN amt_num IS NULL THEN 0 ELSE least((amt_num + 1e-8 >= 100)::INT + (amt_num + 1e-8 >= 1000)::INT + (amt_num + 1e-8 >= 5999)::INT, 2) END)::INT AS bin FROM card_clean
"""))
def digitize(spark, sf):
    return card.clean_card(views.card(spark, sf)).select("row_id", clean.digitize(F.col("amt_num"), [0.0, 100.0, 1000.0, 5999.0]).alias("bin"))


@query(with_("card_pre", f"SELECT row_id, {log_bucket('time_delta_s')}::INT AS bucket FROM card_pre"))
def log_time_bucket(spark, sf):
    return card.preprocess_card(views.card(spark, sf)).select("row_id", clean.log_time_bucket(F.col("time_delta_s")).alias("bucket"))


@query(with_("v_pred", "SELECT event_id, round(1 / (1 + exp(z0 - z1)), 9) AS p1, (1 / (1 + exp(z0 - z1)) >= 0.5)::INT AS pred FROM v_pred"))
def softmax_pred(spark, sf):
    p = predictions(views.predictions(spark, sf).drop("p1"), ["event_id"])
    return p.select("event_id", F.round("p1", 9).alias("p1"), "pred")


@query(with_("v_txn", """
SELECT user_id, seq_order, array_to_string(list_transform(range(16), lambda i: CASE WHEN h = 0 THEN '0.000000' ELSE
  printf('%.6f', CASE WHEN i < 8 THEN sin(2 ** i * pi() * h) ELSE cos(2 ** (i - 8) * pi() * h) END + 0.0000001) END), ' ') AS code
FROM (SELECT *, greatest(coalesce(floor((floor(unix_ts) - floor(lag(unix_ts) OVER (PARTITION BY user_id ORDER BY seq_order))) / 3600), 0), 0) AS h FROM v_txn)
"""), name="frequency_encode")
def frequency_encode_(spark, sf):
    r = ndjson.clean_ndjson(stored_rows(spark, sf))
    r = history.ordered_scan(r, ["user_id"], ndjson.history_order(), previous={"_p": "unix_ts"})
    h = history.gap_hours(F.col("_p"), F.col("unix_ts"))
    code = frequency_encode(h)
    shown = F.transform(code, lambda x: F.when(h == 0, "0.000000").otherwise(F.format_string("%.6f", x + 0.0000001)))
    return r.select("user_id", "seq_order", F.array_join(shown, " ").alias("code"))


def _pooled(df, name="group_id"):
    total = F.aggregate("pooled", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return df.select(name, F.round(total, 4).alias("total"), F.round(F.get("pooled", 0).cast("double"), 5).alias("first_value"))


POOL_SQL = """
SELECT group_id, round(list_sum(list_transform(v, lambda x: x::DOUBLE)), 4) AS total, round(v[1]::DOUBLE, 5) AS first_value
FROM (SELECT group_id, {agg} AS v FROM v_emb GROUP BY group_id)
"""
MEAN_SQL = """
, el AS (SELECT group_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM v_emb),
m AS (SELECT group_id, i, sum(x) / (count(*) + {eps}) AS x FROM el GROUP BY ALL)
SELECT group_id, round(sum(x), 4) AS total, round(max(x) FILTER (i = 0), 5) AS first_value FROM m GROUP BY group_id
"""


def _vec(spark, sf):
    return views.vectors(spark, sf), ["group_id"], "embedding", [F.col("row_id")], 64


@query(with_("v_emb", POOL_SQL.format(agg="arg_max(embedding, row_id)")))
def pool_last(spark, sf):
    return _pooled(pool(*_vec(spark, sf), "last"))


@query(with_("v_emb", POOL_SQL.format(agg="arg_min(embedding, row_id)")))
def pool_first(spark, sf):
    return _pooled(pool(*_vec(spark, sf), "first"))


@query(with_("v_emb", "").rstrip() + MEAN_SQL.format(eps="0"))
def pool_mean(spark, sf):
    return _pooled(pool(*_vec(spark, sf), "mean"))


@query(with_("v_emb", "").rstrip() + MEAN_SQL.format(eps="1e-7"), name="user_pool")
def user_pool_(spark, sf):
    return _pooled(user_pool(*_vec(spark, sf), "pool"))


# -- lookups and joins ---------------------------------------------------------------------


@query(with_("card_pre", """
SELECT row_id, CASE chip_upper WHEN 'SWIPE TRANSACTION' THEN 'SWIPE' WHEN 'CHIP TRANSACTION' THEN 'CHIP' WHEN 'ONLINE TRANSACTION' THEN 'ONLINE' ELSE 'UNK' END AS by_literal,
  CASE chip_upper WHEN 'SWIPE TRANSACTION' THEN 'SWIPE' WHEN 'CHIP TRANSACTION' THEN 'CHIP' WHEN 'ONLINE TRANSACTION' THEN 'ONLINE' ELSE 'UNK' END AS by_table FROM card_pre
"""))
def lookup_mapping(spark, sf):
    c = card.clean_card(views.card(spark, sf)).select("row_id", "chip_upper")
    c = c.withColumn("by_literal", S.MapStep("chip_upper", "CHIP", mapping=tuple(CHIP_MAPPING.items())).label())
    t = spark.createDataFrame(list(CHIP_MAPPING.items()), "k string, v string")
    return align.lookup(c, "chip_upper", t, "k", "v", "UNK", "by_table").drop("chip_upper")


@query(with_("card_pre", f"SELECT row_id, {CAT_CASE} AS industry FROM card_pre"))
def lookup_range(spark, sf):
    c = card.clean_card(views.card(spark, sf))
    return c.select("row_id", clean.range_label(F.col("mcc_int")).alias("industry"))


@query("""
WITH r AS (SELECT p_partkey * 37 % 50000 AS lo, p_partkey * 37 % 50000 + p_size * p_size - 20 AS hi, p_brand AS label, p_partkey * 7919 % 100003 AS seq FROM part),
f AS (SELECT o_orderkey, arg_max(label, seq) AS label FROM orders JOIN r ON o_orderkey BETWEEN lo AND hi GROUP BY o_orderkey)
SELECT o_orderkey, coalesce(label, 'NONE') AS label FROM orders LEFT JOIN f USING (o_orderkey)
""")
def lookup_range_table(spark, sf):
    """Overlapping ranges, one for every part, of which the last holds; some hold nothing."""
    k, size = F.col("p_partkey"), F.col("p_size")
    lo = k * 37 % 50000
    table = views.table(spark, sf, "part").select(lo.alias("lo"), (lo + size * size - 20).alias("hi"), F.col("p_brand").alias("label"), (k * 7919 % 100003).alias("seq"))
    flat = ranges.flatten_ranges(table)
    return ranges.lookup_ranges(views.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", flat, default="NONE")


@query(with_("card_pre", f"SELECT row_id, {DISPLAY_CASE.format(c='mcc_int')} AS shown FROM card_pre"))
def mcc_display_label(spark, sf):
    return card.clean_card(views.card(spark, sf)).select("row_id", clean.mcc_display(F.col("mcc_int")).alias("shown"))


@query(with_("card_idx", f"""
SELECT row_id, (i_chip + {CARD_OFFSETS['CHIP']})::INT AS by_rule, (i_chip + {CARD_OFFSETS['CHIP']})::INT AS by_text, 4 AS unknown FROM card_idx
"""))
def lookup_token_id(spark, sf):
    t = card.fitted_card_steps(merchant_buckets=2000)
    chip = next(s for s in t.steps if s.prefix == "CHIP")
    c = card.clean_card(views.card(spark, sf))
    c = c.select("row_id", (chip.index() + F.lit(t.offsets[chip.name])).cast("int").alias("by_rule"), chip.token().alias("tok"))
    c = t.with_ids(c.withColumn("other", F.concat("tok", F.lit("?"))), "tok", "by_text")
    return t.with_ids(c, "other", "unknown").select("row_id", "by_rule", "by_text", "unknown")


@query(with_("v_txn", "SELECT user_id, max(label) AS label FROM v_txn GROUP BY user_id"))
def lookup_user_label(spark, sf):
    return rows(spark, sf).groupBy("user_id").agg(F.max("label").alias("label"))


@query(with_("card_idx v_target", 'SELECT c.row_id, c."user", c.card, t.y FROM card_idx c JOIN v_target t USING (row_id)'))
def align_labels(spark, sf):
    s, _ = temporal_split_date(views.card(spark, sf))
    s = s.withColumn("y", clean.target(F.col("`Is Fraud?`")))
    return card.preprocess_card(s, keep=["y"]).select("row_id", "user", "card", "y")


@query(with_("v_emb v_card", """
SELECT e.split, row_id, e.label, c."MCC", round(e.embedding[1]::DOUBLE, 6) AS first_value FROM v_emb e JOIN v_card c USING (row_id)
"""))
def align_raw_to_embeddings(spark, sf):
    v = views.vectors(spark, sf)
    raw = views.card(spark, sf).select("row_id", "MCC")
    return align.align(raw, v, ["row_id"]).select("split", "row_id", "label", "MCC", F.round(F.get("embedding", 0).cast("double"), 6).alias("first_value"))


@query(with_("v_emb v_card", """
SELECT row_id, 66::INT AS dim, coalesce("MCC", -1)::DOUBLE AS f0, "Card"::DOUBLE AS f1, round(embedding[1]::DOUBLE, 6) AS f2
FROM v_emb JOIN v_card USING (row_id)
"""))
def hstack_features(spark, sf):
    from pyspark.ml.functions import vector_to_array

    d = align.align(views.card(spark, sf).select("row_id", "MCC", "Card"), views.vectors(spark, sf), ["row_id"])
    a = ml.assemble(d, ["MCC", "Card"], "embedding", 64).withColumn("f", vector_to_array("features"))
    return a.select("row_id", F.size("f").alias("dim"), *[F.round(F.get("f", i), 6).alias(f"f{i}") for i in range(3)])


@query(with_("card_idx", "SELECT row_id, " + ", ".join(f'{t} AS "tok_{n}"' for n, _, _, t in CARD_STEPS[2:6]) + " FROM card_idx"))
def concat_token_columns(spark, sf):
    t = card.fitted_card_steps().transform(card.clean_card(views.card(spark, sf)), keep=["row_id"])
    return t.select("row_id", *[f"tok_{n}" for n, _, _, _ in CARD_STEPS[2:6]])


@query(with_("v_target", """
, picked AS (SELECT row_id, y FROM v_target WHERE split = 'val'),
sized AS (SELECT y, count(*) AS n, sum(count(*)) OVER () AS total FROM picked GROUP BY y),
q AS (SELECT y, n * 200 // total AS fl, n * 200 % total AS rest, total FROM sized),
quota AS (SELECT y, fl + (row_number() OVER (ORDER BY rest DESC, y) <= 200 - sum(fl) OVER ())::INT AS quota FROM q),
ranked AS (SELECT picked.*, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || row_id)) AS r FROM picked)
SELECT c.row_id, c."Amount", c."Merchant Name" AS merchant FROM v_card c WHERE c.row_id IN (SELECT row_id FROM ranked JOIN quota USING (y) WHERE r <= quota)
"""))
def semi_join_eval_rows(spark, sf):
    s, _ = temporal_split_date(views.card(spark, sf))
    val = s.where("split = 'val'").select("row_id", clean.target(F.col("`Is Fraud?`")).alias("y"))
    picked = stratified_subsample(val, "y", 200)
    return align.keep_rows(views.card(spark, sf), picked).select("row_id", "Amount", F.col("Merchant Name").alias("merchant"))


@query(with_("v_pred", """
, neg AS (SELECT z1, row_number() OVER (ORDER BY z1 DESC) AS r, count(*) OVER () AS n FROM v_pred WHERE label = 0),
top AS (SELECT z1 FROM neg WHERE r <= greatest(1, floor(0.1 * n)))
SELECT (SELECT count(*) FROM v_pred WHERE label = 1) AS n_pos, (SELECT count(*) FROM top) AS k, count(*) AS n_pairs,
  round(avg(p.z1 - t.z1), 9) AS mean_margin, round(min(p.z1 - t.z1), 9) AS min_margin, round(max(p.z1 - t.z1), 9) AS max_margin
FROM v_pred p, top t WHERE p.label = 1
"""))
def cross_pos_neg(spark, sf):
    s = pair_summary(views.predictions(spark, sf))
    return s.select("n_pos", "k", "n_pairs", *[F.round(c, 9).alias(c) for c in ("mean_margin", "min_margin", "max_margin")])
