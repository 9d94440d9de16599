"""Aggregates: daily counts, splits, summaries, metrics and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean
from ..operators import clusters, corpus, expand, metrics, profile, sketches, split as sp, tokens as T
from ..operators.pairwise import topk_negatives as hardest
from ..operators.vectors import embedding_metadata as vector_metadata
from ..plans import card, jobs, ndjson
from ..session import fresh_path
from ..sources import incremental
from . import views
from .features import rows, stored_rows
from .registry import query
from .sql import DISPLAY_CASE, with_


def text_date(c="date"):
    return F.col(c).cast("string").alias(c)


@query(with_("daily", "SELECT date::VARCHAR AS date, n FROM daily"))
def daily_counts(spark, sf):
    return sp.daily_counts(sp.with_date(views.card(spark, sf))).select(text_date(), "n")


@query(with_("running", "SELECT date::VARCHAR AS date, n, cumulative::BIGINT AS cumulative FROM running"))
def running_count(spark, sf):
    return sp.running_daily(sp.daily_counts(sp.with_date(views.card(spark, sf)))).select(text_date(), "n", "cumulative")


@query(with_("cutoffs", "SELECT c1::VARCHAR AS c1, c2::VARCHAR AS c2 FROM cutoffs"))
def find_cutoff_date(spark, sf):
    c = sp.cutoff_dates(sp.with_date(views.card(spark, sf)), [0.8, 0.8 + 0.1])
    return c.select(F.col("cutoff_0").cast("string").alias("c1"), F.col("cutoff_1").cast("string").alias("c2"))


@query(with_("running", "SELECT date::VARCHAR AS date, cumulative::BIGINT AS cumulative FROM running WHERE cumulative >= total * 0.5 ORDER BY date LIMIT 1"))
def first_reaching(spark, sf):
    run = sp.running_daily(sp.daily_counts(sp.with_date(views.card(spark, sf))))
    total = F.max("cumulative").over(sp.Window.partitionBy())
    hit = run.withColumn("t", total).where(F.col("cumulative") >= F.col("t") * 0.5)
    return hit.orderBy("date").limit(1).select(text_date(), "cumulative")


@query(with_("v_split", 'SELECT row_id, split FROM v_split'))
def temporal_split_date(spark, sf):
    return sp.temporal_split_date(views.card(spark, sf))[0].select("row_id", "split")


@query(with_("v_rows_split", "SELECT user_id, seq_order, split FROM v_rows_split"))
def temporal_split_quantile(spark, sf):
    return sp.temporal_split_quantile(stored_rows(spark, sf))[0].select("user_id", "seq_order", "split")


@query(with_("v_card", """
SELECT count(*) AS n_rows, 15::BIGINT AS n_columns, count(DISTINCT "User") AS n_users, count(*) FILTER ("Is Fraud?" = 'Yes') AS n_pos,
  round(count(*) FILTER ("Is Fraud?" = 'Yes') / count(*), 9) AS pos_rate FROM v_card
"""))
def dataset_summary(spark, sf):
    return profile.dataset_summary(views.card(spark, sf)).withColumn("pos_rate", F.round("pos_rate", 9))


@query(with_("v_card", """
, s AS (SELECT row_id % 4 = 3 AS late, * FROM v_card), d AS (SELECT 'first' AS refresh, * FROM s WHERE NOT late UNION ALL SELECT 'second', * FROM s)
SELECT refresh, CASE refresh WHEN 'first' THEN 3 ELSE 5 END::BIGINT AS n_files, CASE refresh WHEN 'first' THEN 3 ELSE 2 END::BIGINT AS n_read, count(*) AS n_rows,
  count(*) FILTER ("Is Fraud?" = 'Yes') AS n_pos, count("MCC") AS n_mcc, min("MCC")::DOUBLE AS least_mcc, max("MCC")::DOUBLE AS greatest_mcc, 1::INT AS users_within
FROM d GROUP BY refresh
"""))
def dataset_summary_incremental(spark, sf):
    """Counts of a folder after its first three files and after two more: the second refresh reads
    the two alone. ``users_within``: the distinct users are right within four standard deviations."""
    folder, store = fresh_path(spark, "arriving"), fresh_path(spark, "summaries")
    rows = views.card(spark, sf).select("row_id", "User", "MCC", "Is Fraud?")
    read = lambda paths: spark.read.schema(rows.schema).parquet(*paths)
    kept = incremental.FileSummaries(
        spark, folder, store, read, "*.parquet", ["MCC"], ["User"], F.col("`Is Fraud?`") == "Yes"
    )
    late, out = F.pmod("row_id", F.lit(4)) == 3, None
    for name, part, files in (("first", ~late, 3), ("second", late, 2)):
        rows.where(part).repartition(files).write.mode("append").parquet(folder)
        n_read = len(kept.refresh())
        r = kept.total().withColumn("users", sketches.distinct_of("User")).first()
        exact = read([folder]).agg(F.count_distinct("User").alias("n")).first()["n"]
        within = int(abs(r["users"] - exact) <= sketches.distinct_error() * exact)
        row = [(name, r["n_files"], n_read, r["n_rows"], r["n_pos"], r["n_MCC"], r["min_MCC"], r["max_MCC"], within)]
        one = spark.createDataFrame(row, "refresh string, n_files bigint, n_read bigint, n_rows bigint, n_pos bigint, n_mcc bigint, least_mcc double, greatest_mcc double, users_within int")
        out = one if out is None else out.unionByName(one)
    return out


@query(with_("v_txn", """
SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(*) FILTER (label = 1) AS n_pos, round(count(*) FILTER (label = 1) / count(*), 9) AS pos_rate FROM v_txn
"""))
def ndjson_summary(spark, sf):
    return profile.ndjson_summary(rows(spark, sf)).withColumn("pos_rate", F.round("pos_rate", 9))


@query(with_("v_split", """
, s AS (SELECT coalesce(split, 'total') AS split, count(*) AS n_rows, count(*) FILTER (lower("Is Fraud?") = 'yes') AS n_pos FROM v_split GROUP BY ROLLUP (split))
SELECT split, n_rows, round(n_rows / max(n_rows) OVER () * 100, 9) AS pct, n_pos, round(n_pos / n_rows * 100, 9) AS rate_pct FROM s
"""))
def split_stats(spark, sf):
    s = sp.split_stats(sp.temporal_split_date(views.card(spark, sf))[0], clean.yes_flag(F.col("`Is Fraud?`")))
    return s.withColumns({c: F.round(c, 9) for c in ("pct", "rate_pct")})


@query(with_("v_card", " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, '{t}' AS dtype, count(DISTINCT "{c}") AS n_unique FROM v_card"""
    for c, t in [("User", "bigint"), ("Use Chip", "string"), ("Merchant Name", "string"), ("MCC", "int"), ("Zip", "string")]
)))
def feature_summary(spark, sf):
    return profile.feature_summary(views.card(spark, sf), ["User", "Use Chip", "Merchant Name", "MCC", "Zip"])


@query(with_("v_split", """SELECT "Is Fraud?" AS label, count(*) AS n FROM v_split WHERE split = 'train' GROUP BY 1"""))
def class_distribution(spark, sf):
    return profile.class_distribution(sp.temporal_split_date(views.card(spark, sf))[0].where("split = 'train'"))


RATE_SQL = f"""
SELECT "MCC", count(*) AS n_txns, round(avg((lower("Is Fraud?") = 'yes')::INT) * 100, 9) AS rate_pct, {DISPLAY_CASE.format(c='"MCC"')} AS label
FROM v_split WHERE split = 'train' AND "MCC" IS NOT NULL GROUP BY "MCC" HAVING count(*) >= {{least}} ORDER BY rate_pct DESC, "MCC" LIMIT {{top}}
"""


@query(with_("v_split", RATE_SQL.format(least=500, top=15)))
def fraud_rate_by_mcc(spark, sf):
    train = sp.temporal_split_date(views.card(spark, sf))[0].where("split = 'train'")
    return profile.fraud_rate_by_mcc(train).withColumn("rate_pct", F.round("rate_pct", 9))


@query(with_("v_split", RATE_SQL.format(least=1, top=3)))
def top_n(spark, sf):
    train = sp.temporal_split_date(views.card(spark, sf))[0].where("split = 'train'")
    return profile.fraud_rate_by_mcc(train, 1, 3).withColumn("rate_pct", F.round("rate_pct", 9))


@query(with_("v_card", """
, c AS (SELECT "User", count(*) AS n FROM v_card GROUP BY 1), r AS (SELECT min(n)::DOUBLE AS lo, max(n)::DOUBLE AS hi, floor(median(n))::INT AS median FROM c)
SELECT least(floor(50 * (n - lo) / (hi - lo)), 49)::INT AS bin, count(*) AS n_users, any_value(median) AS median FROM c, r GROUP BY 1
"""))
def txns_per_user(spark, sf):
    hist, median = profile.txns_per_user(views.card(spark, sf))
    return hist.select("bin", "n_users", F.lit(median).alias("median"))


@query(with_("v_card cutoffs", """
, m AS (SELECT "Year" || '-' || lpad("Month"::VARCHAR, 2, '0') AS period, count(*) AS n FROM v_card GROUP BY 1)
SELECT period, n, (row_number() OVER (ORDER BY period) - 1)::INT AS pos, (period IN (strftime(c1, '%Y-%m'), strftime(c2, '%Y-%m')))::INT AS is_cutoff FROM m, cutoffs
"""))
def monthly_counts(spark, sf):
    c = views.card(spark, sf)
    _, cuts = sp.temporal_split_date(c)
    return profile.monthly_counts(c, cuts).withColumn("is_cutoff", F.col("is_cutoff").cast("int"))


@query(with_("card_clean", """
, e AS (SELECT quantile_cont(amt_num, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS q, min(amt_num) AS lo, max(amt_num) AS hi FROM card_clean)
SELECT i::INT AS i, round(q[i + 1], 6) AS quantile, round(lo + (hi - lo) * i / 10, 6) AS uniform FROM e, range(11) t(i)
"""))
def fit_bin_edges(spark, sf):
    c = card.clean_card(views.card(spark, sf))
    q, u = T.fit_edges(c, "amt_num", 10), T.fit_edges(c, "amt_num", 10, "uniform")
    return spark.createDataFrame([(i, round(a, 6), round(b, 6)) for i, (a, b) in enumerate(zip(q, u))], "i int, quantile double, uniform double")


@query(with_("card_clean", """
, e AS (SELECT count(amt_num) AS n, min(amt_num) AS lo, max(amt_num) AS hi, count(DISTINCT ts::DATE) + max((ts IS NULL)::INT) AS days FROM card_clean)
SELECT i::INT AS i, n AS n_values, days::BIGINT AS n_parts, CASE i WHEN 0 THEN lo WHEN 10 THEN hi END AS extreme, 1::INT AS rank_within FROM e, range(11) t(i)
"""))
def fit_bin_edges_sketched(spark, sf):
    """Edges of ten bins from one stored sketch a day, the days of the second half added later. The
    extremes are exact; ``rank_within``: an edge's rank among all values is right within the bound."""
    c = card.clean_card(views.card(spark, sf)).withColumn("day", F.to_date(F.timestamp_seconds("time_s")))
    path = fresh_path(spark, "days")
    late = F.coalesce(F.month("day") > 6, F.lit(True))
    for part in (~late, late):
        sketches.part_summaries(c.where(part), ["day"], ["amt_num"]).write.mode("append").parquet(path)
    parts = spark.read.parquet(path)
    edges = sketches.edges_from_summaries(parts, "amt_num", 10)
    m = sketches.merge_summaries(parts.withColumn("n_parts", F.lit(1).cast("bigint")).drop("day")).first()
    v = F.col("amt_num")
    ranks = c.agg(*[f(v, e).alias(f"{n}{i}") for i, e in enumerate(edges) for n, f in (("b", lambda v, e: F.count_if(v < e)), ("t", lambda v, e: F.count_if(v <= e)))]).first()
    n, slack = m["n_amt_num"], sketches.rank_error() * m["n_amt_num"]
    fine = [int(ranks[f"b{i}"] - slack <= n * i / 10 <= ranks[f"t{i}"] + slack) for i in range(11)]
    rows = [(i, n, m["n_parts"], edges[i] if i in (0, 10) else None, fine[i]) for i in range(11)]
    return spark.createDataFrame(rows, "i int, n_values bigint, n_parts bigint, extreme double, rank_within int")


@query("""
WITH v AS (SELECT p_size::DOUBLE AS x, count(*) AS w FROM part GROUP BY 1),
p AS (SELECT x, row_number() OVER (ORDER BY x) AS i, sum(w) OVER u AS s0, sum(w * x) OVER u AS s1, sum(w * x * x) OVER u AS s2 FROM v WINDOW u AS (ORDER BY x)),
q AS (SELECT i, s0, s1, s2 FROM p UNION ALL SELECT 0, 0, 0, 0),
run AS (
  SELECT a.i AS a, z.i AS z, (z.s2 - a.s2) - (z.s1 - a.s1) ** 2 / (z.s0 - a.s0) AS cost, (z.s1 - a.s1) / (z.s0 - a.s0) AS centre FROM q a JOIN q z ON z.i > a.i),
best AS (
  SELECT f.centre AS c1, m.centre AS c2, l.centre AS c3, f.cost + m.cost + l.cost AS cost
  FROM run f JOIN run m ON m.a = f.z JOIN run l ON l.a = m.z WHERE f.a = 0 AND l.z = (SELECT max(i) FROM q) ORDER BY round(f.cost + m.cost + l.cost, 6), f.z, m.z LIMIT 1)
SELECT 3::INT AS bins, round(cost::DOUBLE, 3) AS cost, round(((c1 + c2) / 2)::DOUBLE, 6) AS first_edge, round(((c2 + c3) / 2)::DOUBLE, 6) AS second_edge FROM best
""")
def fit_bin_edges_kmeans(spark, sf):
    """The least cost of three clusters of sizes, over all pairs of borders in the SQL."""
    edges, cost = clusters.kmeans_edges(views.table(spark, sf, "part"), "p_size", 3)
    return spark.createDataFrame([(3, round(cost, 3), round(edges[1], 6), round(edges[2], 6))], "bins int, cost double, first_edge double, second_edge double")


@query(with_("nd_all", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", v AS label, (row_number() OVER (ORDER BY v = 'UNK', v) - 1)::INT AS local_idx FROM (SELECT DISTINCT {c} AS v FROM nd_all UNION SELECT 'UNK')"
    for c in ("merch_type", "txn_code", "card_level")
)))
def fit_categories(spark, sf):
    return T.fit_categories(ndjson.clean_ndjson(rows(spark, sf)), ["merch_type", "txn_code", "card_level"]).select("column", "label", "local_idx")


@query(with_("split_seq", """
SELECT split, count(*) AS n_sequences, sum(len(string_split(text, ' ')))::BIGINT AS n_tokens, sum(n_txns)::BIGINT AS n_txns, sum(strlen(text) + 1)::BIGINT AS n_bytes
FROM split_seq GROUP BY split
"""))
def corpus_stats(spark, sf):
    seqs, _ = jobs.card_corpus(views.card(spark, sf), 5, hash="md5")
    return corpus.corpus_stats(seqs, ["split"])


@query(with_("v_card", """
, w AS (SELECT avg(len(list_filter(string_split(concat_ws(' ', "User", "Card", "Year", "Month", "Day", "Time", "Amount", "Use Chip", "Merchant Name", "Merchant City", "Zip"), ' '), lambda x: x <> ''))) AS a FROM v_card)
SELECT 12::BIGINT AS tokens_per_txn, round(a, 9) AS raw_tokens_per_txn, 315::BIGINT AS txns_per_window, floor(4096 / (a + 1))::BIGINT AS raw_txns_per_window, round(a / 12, 9) AS ratio FROM w
"""))
def token_efficiency(spark, sf):
    names = ["User", "Card", "Year", "Month", "Day", "Time", "Amount", "Use Chip", "Merchant Name", "Merchant City", "Zip"]
    raw = F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in names])
    e = corpus.token_efficiency(views.card(spark, sf), 12, raw)
    return e.withColumns({c: F.round(c, 9) for c in ("raw_tokens_per_txn", "ratio")})


RANK_SQL = """
, g AS (SELECT p1, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM v_pred GROUP BY p1),
c AS (SELECT *, sum(pos) OVER (ORDER BY p1 DESC) AS tp, sum(neg) OVER (ORDER BY p1 DESC) AS fp FROM g)
"""


@query(with_("v_pred", """
, g AS (SELECT p1, label, rank() OVER (ORDER BY p1) AS lo, count(*) OVER (PARTITION BY p1) AS ties FROM v_pred)
SELECT round((sum(lo + (ties - 1) / 2) FILTER (label = 1) - sum(label)::DOUBLE * (sum(label) + 1) / 2) / (sum(label)::DOUBLE * sum(1 - label)), 9) AS auc,
  sum(label)::BIGINT AS n_pos, sum(1 - label)::BIGINT AS n_neg FROM g
"""))
def roc_auc(spark, sf):
    return metrics.ranking_metrics(views.predictions(spark, sf)).select(F.round("auc", 9).alias("auc"), "n_pos", "n_neg")


@query(with_("v_pred", RANK_SQL + "SELECT round(sum(pos / (SELECT sum(pos) FROM g) * tp / (tp + fp)), 9) AS ap FROM c"))
def average_precision(spark, sf):
    return metrics.ranking_metrics(views.predictions(spark, sf)).select(F.round("ap", 9).alias("ap"))


@query(with_("v_pred", RANK_SQL + "SELECT p1 AS score, pos::BIGINT AS pos, neg::BIGINT AS neg, tp::BIGINT AS tp, fp::BIGINT AS fp FROM c"))
def cumulative_tp_fp(spark, sf):
    return metrics.cumulative_tp_fp(views.predictions(spark, sf))


@query(with_("v_pred", """
, c AS (SELECT count(*) FILTER (p1 >= 0.5 AND label = 1)::DOUBLE AS tp, count(*) FILTER (p1 >= 0.5 AND label = 0)::DOUBLE AS fp,
  count(*) FILTER (p1 < 0.5 AND label = 1)::DOUBLE AS fn, count(*) FILTER (p1 < 0.5 AND label = 0)::DOUBLE AS tn FROM v_pred)
SELECT round((tp + tn) / (tp + fp + fn + tn), 9) AS acc, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round(tp / (tp + fp), 9) AS "precision", round(tp / (tp + fn), 9) AS recall FROM c
"""))
def threshold_metrics(spark, sf):
    m = metrics.threshold_metrics(views.predictions(spark, sf))
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


CE = "ln(exp(z0) + exp(z1)) - CASE WHEN label = 1 THEN z1 ELSE z0 END"


def _loss(name, **kw):
    return lambda spark, sf: metrics.build_loss(name, **kw)(views.predictions(spark, sf)).select(F.round("loss", 9).alias("loss"))


query(with_("v_pred", f"SELECT round(avg({CE}), 9) AS loss FROM v_pred"), "cross_entropy")(_loss("cross_entropy"))
query(with_("v_pred", f"""
, c AS (SELECT ({CE}) * CASE WHEN label = 1 THEN 10 ELSE 1 END AS ce FROM v_pred) SELECT round(avg(0.25 * (1 - exp(-ce)) ** 2 * ce), 9) AS loss FROM c
"""), "focal_weighted")(_loss("focal_weighted"))
query(with_("v_pred", f"""
, c AS (SELECT label, amount, {CE} AS ce FROM v_pred)
SELECT round(avg(CASE WHEN label = 1 THEN least(greatest(0.5 * amount / 100000, 1), 4) ELSE 1 END * 0.25 * (1 - exp(-ce)) ** 2 * ce), 9) AS loss FROM c
"""), "focal_amount")(_loss("focal_amount"))
query(with_("v_pred", """
, neg AS (SELECT z1, row_number() OVER (ORDER BY z1 DESC) AS r, count(*) OVER () AS n FROM v_pred WHERE label = 0),
top AS (SELECT z1 FROM neg WHERE r <= greatest(1, floor(0.1 * n)))
SELECT round(avg(1 / (1 + exp(p.z1 - t.z1))), 9) AS loss FROM v_pred p, top t WHERE p.label = 1
"""), "pauc_sigmoid")(_loss("pauc_sigmoid"))


@query(with_("v_pred", """
, neg AS (SELECT z1, row_number() OVER (ORDER BY z1 DESC) AS r, count(*) OVER () AS n FROM v_pred WHERE label = 0)
SELECT z1 AS score, count(*) AS n FROM neg WHERE r <= floor(0.1 * n) GROUP BY z1
"""))
def topk_negatives(spark, sf):
    p = views.predictions(spark, sf)
    n = p.agg(F.count_if(F.col("label") == 0).alias("n")).first()["n"]
    return hardest(p, int(0.1 * n)).select("score", "n")


@query(with_("v_pred", f"SELECT round(avg({CE}), 9) AS avg_loss, count(*) AS n_samples FROM v_pred"))
def mean_loss_across_workers(spark, sf):
    loss = metrics.row_cross_entropy(F.col("z0"), F.col("z1"), F.col("label"))
    return metrics.evaluate(views.predictions(spark, sf), loss).select(F.round("avg_loss", 9).alias("avg_loss"), "n_samples")


@query(with_("v_pred", """
, m AS (SELECT 0 AS pos, 'raw' AS model, p1 AS s, label FROM v_pred UNION ALL SELECT 1, 'embed', z1, label FROM v_pred UNION ALL SELECT 2, 'combined', p1 + z1, label FROM v_pred),
g AS (SELECT pos, model, s, sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS n FROM m GROUP BY ALL),
c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM g WINDOW w AS (PARTITION BY pos ORDER BY s DESC)),
r AS (SELECT pos, model, sum(n * (tp - p / 2)) / (sum(p) * sum(n)) AS auc, sum(p * tp / (tp + fp)) / sum(p) AS ap FROM c GROUP BY ALL)
SELECT pos, model, round(auc, 9) AS test_auc, round(ap, 9) AS test_ap, (pos = arg_max(pos, auc) OVER ())::INT AS best_auc, (pos = arg_max(pos, ap) OVER ())::INT AS best_ap,
  round((auc / first_value(auc) OVER (ORDER BY pos) - 1) * 100, 6) AS auc_lift_pct, round((ap / first_value(ap) OVER (ORDER BY pos) - 1) * 100, 6) AS ap_lift_pct,
  (arg_max(pos, auc) OVER () = arg_max(pos, ap) OVER ())::INT AS metrics_agree FROM r
"""))
def model_comparison(spark, sf):
    p = views.predictions(spark, sf).withColumn("both", F.col("p1") + F.col("z1"))
    out = None
    for i, (name, score) in enumerate([("raw", "p1"), ("embed", "z1"), ("combined", "both")]):
        r = metrics.ranking_metrics(p, score).select(
            F.lit(i).alias("pos"), F.lit(name).alias("model"), F.col("auc").alias("test_auc"), F.col("ap").alias("test_ap")
        )
        out = r if out is None else out.unionByName(r)
    c = metrics.model_comparison(out)
    flags = {f: F.col(f).cast("int") for f in ("best_auc", "best_ap", "metrics_agree")}
    rounded = {f: F.round(f, n) for f, n in [("test_auc", 9), ("test_ap", 9), ("auc_lift_pct", 6), ("ap_lift_pct", 6)]}
    return c.withColumns(flags | rounded)


@query(with_("v_emb", "SELECT split, count(*) AS n_rows, max(len(embedding))::INT AS dim FROM v_emb GROUP BY split"))
def embedding_metadata(spark, sf):
    return vector_metadata(views.vectors(spark, sf))
