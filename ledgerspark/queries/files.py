"""Readers and writers: every query writes derived data, reads it back and returns it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus, expand, tokens as T
from ..operators.split import temporal_split_date, with_date
from ..operators.metrics import evaluate, predictions, row_cross_entropy
from ..operators.vectors import embedding_metadata
from ..plans import card, jobs, ndjson
from ..session import fresh_path, materialize
from ..sources import epochs, readers, stages, writers
from . import views
from .features import stored_rows
from .registry import query
from .sql import CARD_OFFSETS, with_

ROW_COLUMNS = [
    "user_id", "label", "seq_order", "issuer_addr", "issuer_bank", "card_level", "year", "month", "day", "hour", "minutes",
    "seconds", "unix_ts", "acq_addr", "acq_bank", "txn_code", "channel", "pos_input", "resp_code", "merch_type", "conn_mode",
    "merch_name", "amount", "dow", "period",
]


@query(with_("v_card", 'SELECT *, 1 AS is_key FROM (SELECT * EXCLUDE (row_id) FROM v_card)'))
def scan_csv(spark, sf):
    path = fresh_path(spark, "csv")
    names = [c for c in views.card(spark, sf).columns if c != "row_id"]
    # Another order of columns than the schema's, and one column more.
    views.card(spark, sf).select(*[F.col(f"`{c}`") for c in [*names[5:], *names[:5]]], F.lit("").alias("Errors?")).write.option("header", True).option("nullValue", "\\N").option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)
    out = readers.with_row_key(readers.read_card_csv(spark, path, nullValue="\\N"))
    return out.select(*[F.col(f"`{c}`") for c in names], F.when(F.length("row_id") > 33, 1).otherwise(0).alias("is_key"))


@query(with_("v_card", 'SELECT row_id, "Amount", "MCC" FROM v_card'))
def scan_parquet(spark, sf):
    path = fresh_path(spark, "card")
    views.card(spark, sf).write.parquet(path)
    return readers.read_parquet(spark, path, ["row_id", "Amount", "MCC"])


@query(with_("v_txn", """
SELECT user_id, max(label) AS label, count(*)::INT AS n_txns FROM v_txn GROUP BY user_id UNION ALL SELECT 'u-empty', 1, 0
"""))
def scan_ndjson(spark, sf):
    r = readers.read_records(spark, views.record_folder(spark, sf), pattern="*.txt")
    return r.groupBy(F.col("cert_sm3").alias("user_id")).agg(F.max("label").alias("label"), F.sum(F.size("trans")).cast("int").alias("n_txns"))


@query(with_("v_rows", f"SELECT {', '.join(ROW_COLUMNS)} FROM v_rows"))
def load_ndjson(spark, sf):
    return expand.expand_records(readers.read_records(spark, views.record_folder(spark, sf), pattern="*.txt")).select(*ROW_COLUMNS)


@query(with_("card_seq", "SELECT text FROM card_seq"))
def scan_corpus(spark, sf):
    seqs, _ = jobs.card_corpus(views.card(spark, sf), 5, hash="md5", split=False)
    path = fresh_path(spark, "corpus")
    writers.write_corpus(seqs, path)
    return readers.read_corpus(spark, path)


@query(with_("split_seq", "SELECT split, count(*) AS n_lines, sum(length(text))::BIGINT AS n_chars FROM split_seq GROUP BY split"))
def sink_corpus(spark, sf):
    seqs, _ = jobs.card_corpus(views.card(spark, sf), 5, hash="md5")
    path = fresh_path(spark, "corpus")
    writers.write_corpus(corpus.with_line_numbers(seqs, ["split", "user", "card"]), path)
    t = spark.read.text(path)
    return t.groupBy("split").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("value")).alias("n_chars"))


@query(with_("v_emb", "SELECT row_id, split, label, round(embedding[1]::DOUBLE, 6) AS first_value FROM v_emb WHERE split = 'train'"))
def scan_embeddings(spark, sf):
    path = fresh_path(spark, "embeddings")
    writers.write_embeddings(views.vectors(spark, sf).drop("group_id"), path)
    e = readers.read_embeddings(spark, path, "train")
    return e.select("row_id", "split", "label", F.round(F.get("embedding", 0).cast("double"), 6).alias("first_value"))


@query(with_("v_emb", "SELECT split, count(*) AS n_rows, max(len(embedding))::INT AS dim, sum(label)::BIGINT AS n_pos FROM v_emb GROUP BY split"))
def sink_embeddings(spark, sf):
    v = views.vectors(spark, sf)
    path = fresh_path(spark, "embeddings")
    writers.write_embeddings(v, path, metadata=embedding_metadata(v, label="label"))
    return spark.read.schema("split string, n_rows bigint, dim int, n_pos bigint").json(path + "_metadata")


@query(with_("v_split", 'SELECT split, row_id, "Amount" FROM v_split'))
def sink_splits(spark, sf):
    path = fresh_path(spark, "splits")
    writers.write_splits(temporal_split_date(views.card(spark, sf))[0], path)
    return spark.read.parquet(path).select(F.col("split").cast("string").alias("split"), "row_id", "Amount")


@query(with_("nd_seq", """
SELECT split, row_number() OVER (PARTITION BY split ORDER BY user_id, chunk_id) - 1 AS line_idx, user_id, chunk_id, n_txns, label FROM nd_seq
"""))
def sink_sidecar(spark, sf):
    seqs, _ = jobs.ndjson_corpus(stored_rows(spark, sf), 20, hash="md5")
    g = ["split", "user_id"]
    path = fresh_path(spark, "sidecar")
    writers.write_sidecar(corpus.with_line_numbers(seqs, g).drop("text"), path)
    return spark.read.schema("split string, line_idx bigint, user_id string, chunk_id int, n_txns bigint, label int").json(path)


@query(with_("nd_vocab", "SELECT token, global_id FROM nd_vocab"))
def sink_vocab(spark, sf):
    fit_rows = ndjson.clean_ndjson(stored_rows(spark, sf)).withColumn("time_delta_s", F.lit(0.0))
    fitted = ndjson.ndjson_steps(hash="md5").fit(fit_rows)
    path = fresh_path(spark, "vocab")
    fitted.save(spark, path)
    return T.Tokens.load(spark, path).vocab(spark).select("token", "global_id")


@query(with_("nd_all nd_all_edges nd_vocab", """
SELECT (unnest(range(21)))::INT AS i, round(unnest(e), 6) AS edge, (SELECT count(*) FROM nd_vocab) AS n_tokens,
  (SELECT count(*) FROM nd_vocab WHERE token LIKE 'MCC_%') AS n_types FROM nd_all_edges
"""))
def scan_vocab(spark, sf):
    """Edges and labels of a saved step list, loaded again."""
    rows = ndjson.clean_ndjson(stored_rows(spark, sf)).withColumn("time_delta_s", F.lit(0.0))
    path = fresh_path(spark, "vocab")
    ndjson.ndjson_steps(hash="md5").fit(rows).save(spark, path)
    loaded = T.Tokens.load(spark, path)
    counts = loaded.vocab(spark).agg(F.count(F.lit(1)).alias("n_tokens"), F.count_if(F.col("token").startswith("MCC_")).alias("n_types"))
    edges = F.array(*[F.lit(e) for e in loaded.steps[0].edges])
    out = counts.select("n_tokens", "n_types", F.posexplode(edges).alias("i", "edge"))
    return out.select("i", F.round("edge", 6).alias("edge"), "n_tokens", "n_types")


@query(with_("v_pred", """
SELECT event_id, "user", label, amount, round(1 / (1 + exp(z0 - z1)), 9) AS p1, round(1 - 1 / (1 + exp(z0 - z1)), 9) AS p0,
  (z1 >= z0)::INT AS pred FROM v_pred
"""))
def sink_predictions(spark, sf):
    logits = views.predictions(spark, sf).drop("p1")
    p = predictions(logits, ["event_id", "user", "label", "amount", "z0", "z1"])
    path = fresh_path(spark, "predictions")
    writers.write_predictions(p, path, evaluate(p, row_cross_entropy(F.col("z0"), F.col("z1"), F.col("label"))))
    back = spark.read.schema("event_id bigint, user string, label int, amount double, p0 double, p1 double, pred int").json(path)
    return back.select("event_id", "user", "label", "amount", F.round("p0", 9).alias("p0"), F.round("p1", 9).alias("p1"), "pred")


@query(with_("v_split", "SELECT split, count(*) AS n_rows, 1 AS builds FROM v_split GROUP BY split"))
def stage_skip_or_force(spark, sf):
    path, builds = fresh_path(spark, "stage"), []

    def build():
        builds.append(1)
        return temporal_split_date(views.card(spark, sf))[0]

    writers.stage(spark, path, build, partition_by=["split"])
    again = writers.stage(spark, path, build, partition_by=["split"])
    return again.groupBy(F.col("split").cast("string").alias("split")).agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "builds", F.lit(len(builds))
    )


@query(with_("v_split", """
, late AS (SELECT count(*) FILTER (o % 3 = 0) AS third, count(*) FILTER (o % 5 = 0) AS fifth FROM (SELECT row_id AS o FROM v_split WHERE split = 'test'))
SELECT 'first' AS run, 'dated,counts,picked' AS built, third AS n_rows FROM late UNION ALL SELECT 'again', '', third FROM late
UNION ALL SELECT 'parameter', 'picked', fifth FROM late UNION ALL SELECT 'file', 'dated,counts,picked', 2 * fifth FROM late UNION ALL SELECT 'back', '', 2 * fifth FROM late
"""))
def stage_digests(spark, sf):
    """What is built, and the rows of the last stage: at first, unchanged, with another parameter, with
    one file more, and unchanged again."""
    source, root = fresh_path(spark, "cards"), fresh_path(spark, "stages")
    views.card(spark, sf).write.parquet(source)
    cutoff = temporal_split_date(views.card(spark, sf))[1][1]

    def run(every: int):
        dated = stages.Stage("dated", lambda s, _, paths: with_date(s.read.parquet(*paths)).where(F.col("date").isNotNull()), [source], params={"cutoff": str(cutoff)})
        counts = stages.Stage("counts", lambda s, p, _: p[0].groupBy("date").agg(F.count(F.lit(1)).alias("n")), parents=[dated])
        picked = stages.Stage(
            "picked", lambda s, p, _: p[0].where((F.col("row_id") % every == 0) & (F.col("date") >= F.lit(cutoff))).join(p[1], "date"), parents=[dated, counts], params={"every": every}
        )
        out, built = stages.run_stages(spark, picked, root)
        return ",".join(built), out.count()

    seen = [("first", *run(3)), ("again", *run(3)), ("parameter", *run(5))]
    views.card(spark, sf).write.mode("append").parquet(source)
    seen += [("file", *run(5)), ("back", *run(5))]
    return spark.createDataFrame(seen, "run string, built string, n_rows bigint")


@query(with_("v_txn", "SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, 1 AS max_shards_per_user, 3 AS n_shards FROM v_txn"))
def export_train_shards(spark, sf):
    rows = expand.expand_records(views.records(spark, sf)).select("user_id", "seq_order", "unix_ts", "amount")
    shards = writers.write_shards(rows, fresh_path(spark, "shards"), 3, "user_id")
    per_user = shards.groupBy("user_id", "shard").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("s"), F.collect_set("shard").alias("ids")
    )
    return per_user.agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_users"), F.max("s").cast("int").alias("max_shards_per_user"),
        F.size(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("n_shards"),
    )


@query("""
WITH RECURSIVE n AS (SELECT count(*) AS n, floor(sqrt(greatest(count(*) - 1, 0)))::BIGINT + 1 AS b FROM orders),
p AS (SELECT n, b, (n + b - 1) // b AS a FROM n),
s AS (
  SELECT o_orderkey, e AS epoch, x // b AS l, x % b AS r, 0 AS k
  FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS x FROM orders), (VALUES (0), (1)) AS t(e), p
  UNION ALL
  SELECT o_orderkey, epoch, CASE WHEN k % 2 = 0 THEN (l + ('0x' || substr(md5('42:' || epoch || ':' || (k % 6) || ':' || r), 1, 8))::BIGINT % a) % a ELSE l END,
    CASE WHEN k % 2 = 1 THEN (r + ('0x' || substr(md5('42:' || epoch || ':' || (k % 6) || ':' || l), 1, 8))::BIGINT % b) % b ELSE r END, k + 1
  FROM s, p WHERE NOT (k > 0 AND k % 6 = 0 AND l * b + r < n))
SELECT o_orderkey, epoch::INT AS epoch, ((l * b + r) % 3)::INT AS rank, ((l * b + r) // 3)::BIGINT AS position FROM s, p WHERE k > 0 AND k % 6 = 0 AND l * b + r < n
""")
def export_train_epochs(spark, sf):
    """Rank and position of every order in two epochs of a seeded order over three ranks."""
    rows = materialize(epochs.numbered(views.table(spark, sf, "orders").select("o_orderkey"), [F.col("o_orderkey")]), "numbered")
    twice = rows.withColumn("epoch", F.explode(F.array(F.lit(0), F.lit(1))))
    return epochs.epoch_slots(twice, rows.count(), F.col("epoch"), 3, hash="md5").drop("row_number")


@query(with_("v_split", 'SELECT row_id, split FROM v_split'))
def concat_splits(spark, sf):
    s, _ = temporal_split_date(views.card(spark, sf))
    parts = [s.where(F.col("split") == x).select("row_id", "split") for x in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(with_("v_card", "SELECT row_id, \"User\" FROM v_card UNION ALL SELECT row_id, \"User\" FROM v_card"))
def concat_files(spark, sf):
    a, b = fresh_path(spark, "part"), fresh_path(spark, "part")
    c = views.card(spark, sf).select("row_id", "User")
    c.write.parquet(a)
    c.write.parquet(b)
    return readers.read_parquet(spark, [a, b])


@query(with_("v_split", "SELECT 0::BIGINT AS n_overlap, 0::BIGINT AS n_missing, count(*) AS n_rows FROM v_split"))
def split_disjoint_complete(spark, sf):
    s, _ = temporal_split_date(views.card(spark, sf))
    seen = s.groupBy("row_id").agg(F.count_distinct("split").alias("k"), F.count(F.lit(1)).alias("n"))
    dated = with_date(views.card(spark, sf)).where(F.col("date").isNotNull()).select("row_id")
    missing = dated.join(seen, "row_id", "left_anti").agg(F.count(F.lit(1)).alias("n_missing"))
    sums = seen.agg(F.count_if(F.col("k") > 1).alias("n_overlap"), F.sum("n").alias("n_rows"), F.lit(1).alias("j"))
    return sums.join(missing.withColumn("j", F.lit(1)), "j").select("n_overlap", "n_missing", "n_rows")
