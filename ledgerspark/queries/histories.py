"""Ordered columns per history, and ranks over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean
from ..operators import history
from ..operators.ordered import global_prefix_sum as prefix_sum
from ..operators.ordered import global_rank as rank_all
from ..operators.ordered import ordered_scan
from ..plans import card, ndjson
from ..session import fresh_path, materialize
from ..streaming.tokens import continued_rows, stream_card_gaps, stream_records
from . import views
from .features import rows, stored_rows
from .registry import query
from .sql import with_


def nd(spark, sf):
    return ndjson.clean_ndjson(stored_rows(spark, sf))


@query(with_("card_pre", 'SELECT row_id, "user", card, time_delta_s FROM card_pre'))
def time_delta_card(spark, sf):
    return card.preprocess_card(views.card(spark, sf)).select("row_id", "user", "card", "time_delta_s")


@query(with_("nd_all", "SELECT user_id, seq_order, round(time_delta_s, 6) AS time_delta_s FROM nd_all"))
def time_delta_user(spark, sf):
    return ndjson.preprocess_ndjson(stored_rows(spark, sf)).select("user_id", "seq_order", F.round("time_delta_s", 6).alias("time_delta_s"))


def drained(stream, out: str, checkpoint: str) -> None:
    """Run the stream on what has arrived and stop; the next run goes on from its checkpoint."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


DELIVERIES = 3


@query(with_("nd_all", "SELECT user_id, seq_order, round(time_delta_s, 6) AS time_delta_s, false AS late FROM nd_all"))
def stream_time_delta_user(spark, sf):
    """Histories that arrive in pieces of 20 transactions without places, in three deliveries; each
    is read by a query that starts from the checkpoint of the one before."""
    rec = F.floor(F.col("_pos") / 20)
    at = F.least(F.coalesce("_rec", F.lit(0)), F.lit(DELIVERIES - 1)).alias("_at")
    # Stored: the records are built once, not for every delivery.
    lines = materialize(views.record_lines(spark, sf, pieces=rec, places=False).select("value", at), "lines")
    folder, out, checkpoint = (fresh_path(spark, x) for x in ("pieces", "gaps", "offsets"))
    for k in range(DELIVERIES):
        lines.where(F.col("_at") == k).select("value").write.mode("append").text(folder)
        drained(continued_rows(stream_records(spark, folder, pattern="*.txt")).select("user_id", "seq_order", "time_delta_s", "late"), out, checkpoint)
    rows = spark.read.schema("user_id string, seq_order long, time_delta_s double, late boolean").parquet(out)
    return rows.select("user_id", F.col("seq_order").cast("int").alias("seq_order"), F.round("time_delta_s", 6).alias("time_delta_s"), "late")


@query(with_("card_pre", 'SELECT row_id, "user", card, pos, time_delta_s, false AS late FROM card_pre'))
def stream_time_delta_card(spark, sf):
    """Card rows that arrive in three deliveries, by year; those without a time in the last one."""
    rows = views.card(spark, sf)
    known = clean.timestamp_from_parts(F.col("Year"), F.col("Month"), F.col("Day"), F.col("Time")).isNotNull()
    at = F.when(known & (F.col("Year") < 1997), 0).when(known & (F.col("Year") < 1999), 1).otherwise(2)
    folder, out, checkpoint = (fresh_path(spark, x) for x in ("cards", "gaps", "offsets"))
    for k in range(DELIVERIES):
        rows.where(at == k).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(rows.schema).parquet(folder)
        drained(stream_card_gaps(stream).select("row_id", "user", "card", "pos", "time_delta_s", "late"), out, checkpoint)
    return spark.read.schema("row_id long, user long, card int, pos long, time_delta_s double, late boolean").parquet(out)


@query(with_("card_pre", "SELECT row_id, pos FROM card_pre"))
def cumcount(spark, sf):
    c = card.clean_card(views.card(spark, sf))
    return history.with_position(c, card.KEYS, card.history_order()).select("row_id", "pos")


@query(with_("card_pre", "SELECT row_id, (pos // 5)::INT AS chunk_id FROM card_pre"))
def chunk_id(spark, sf):
    c = history.with_position(card.clean_card(views.card(spark, sf)), card.KEYS, card.history_order())
    return c.select("row_id", history.chunk_of(F.col("pos"), 5).alias("chunk_id"))


@query(with_("v_txn", """
SELECT user_id, seq_order, 20 AS kept FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq_order DESC) AS r FROM v_txn) WHERE r <= 20
"""))
def last_n_txns(spark, sf):
    return history.last_n(rows(spark, sf), ["user_id"], [F.col("seq_order"), F.col("unix_ts")], 20).select(
        "user_id", "seq_order", F.lit(20).alias("kept")
    )


@query(with_("v_txn", """
SELECT user_id, seq_order, greatest(coalesce(floor((floor(unix_ts)::BIGINT - lag(floor(unix_ts)::BIGINT) OVER (PARTITION BY user_id ORDER BY seq_order)) / 3600), 0), 0)::BIGINT AS hours FROM v_txn
"""))
def delta_hours(spark, sf):
    r = ordered_scan(nd(spark, sf), ["user_id"], ndjson.history_order(), previous={"_p": "unix_ts"})
    return r.select("user_id", "seq_order", history.gap_hours(F.col("_p"), F.col("unix_ts")).alias("hours"))


@query(with_("nd_all", "SELECT user_id, arg_max(amount, seq_order) AS amount FROM nd_all GROUP BY user_id"))
def last_amount(spark, sf):
    return history.last_value(nd(spark, sf), ["user_id"], "amount", [F.col("seq_order"), F.col("unix_ts")], "amount")


@query(with_("v_txn", "SELECT user_id, count(*)::INT AS lens_in, max(seq_order)::BIGINT AS last_position FROM v_txn GROUP BY user_id"))
def position_ids(spark, sf):
    p = history.with_position(nd(spark, sf), ["user_id"], ndjson.history_order(), "position")
    return p.groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("lens_in"), F.max("position").alias("last_position"))


@query(with_("card_pre", 'SELECT row_id, "user", card, pos, lag(row_id) OVER (PARTITION BY "user", card ORDER BY pos) AS previous_row FROM card_pre'))
def sort_history(spark, sf):
    c = card.clean_card(views.card(spark, sf))
    return ordered_scan(c, card.KEYS, card.history_order(), position="pos", previous={"previous_row": "row_id"}).select(
        "row_id", "user", "card", "pos", "previous_row"
    )


@query(with_("card_seq", 'SELECT "user", card, chunk_id, row_number() OVER (ORDER BY "user", card, chunk_id) - 1 AS line_idx FROM card_seq'))
def global_rank(spark, sf):
    c = history.with_position(card.clean_card(views.card(spark, sf)), card.KEYS, card.history_order())
    chunks = c.select("user", "card", history.chunk_of(F.col("pos"), 5).alias("chunk_id")).distinct()
    # A low row limit so that the query itself takes the way of large tables.
    return rank_all(chunks, [F.col("user"), F.col("card"), F.col("chunk_id")], "line_idx", hot_rows=2000)


@query(with_("v_pred", "SELECT event_id, sum(amount) OVER (ORDER BY z1, event_id)::BIGINT AS running_amount FROM v_pred"))
def global_prefix_sum(spark, sf):
    p = views.predictions(spark, sf).select("event_id", "z1", F.col("amount").cast("bigint").alias("amount"))
    return prefix_sum(p, [F.col("z1"), F.col("event_id")], {"running_amount": "amount"}, hot_rows=2000).select("event_id", "running_amount")
