"""Transaction data derived from the given tables.

``orders``/``customer`` become card rows, ``events`` become nested user records and
predictions, ``embeddings`` become vectors with splits. Only integer arithmetic and
string building, so that other engines derive the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import ordered_scan
from ..session import fresh_path

RECORD_TXNS = 4096  # transactions per nested record; a longer history comes in several, with their places

# Records appended to the derived ones: no transactions, no label, non-ASCII merchant.
EDGE_RECORDS = [
    '{"cert_sm3":"u-empty","label":1,"trans":[]}',
    '{"cert_sm3":"u-nolabel","trans":[["addr_1","bank_1","普",2024,1,9,9,5,0,1704791100.0,"saddr_1","sbank_1",'
    '"view","ch_1","pos_1","resp_1","mcc_1","直","Shop #1",250,"ab","cd"]]}',
    '{"cert_sm3":"u-cjk","label":0,"trans":[["addr_2","bank_2","金",2024,1,10,23,59,59,1704931199.0,"saddr_2","sbank_2",'
    '"click","ch_2","pos_2","resp_2","mcc_2","间","支付宝-转账/**华","1,250","ab","cd"]]}',
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _s(x) -> Column:
    return x.cast("string")


def card(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    k = F.col("o_orderkey")
    bad = k % 1009 == 0
    cents = k * 7919 % 600000
    dollars = F.floor(cents / 100)
    thousands = F.floor(dollars / 1000)
    shown = F.when(
        dollars >= 1000, F.concat(_s(thousands), F.lit(","), F.lpad(_s(dollars % 1000), 3, "0"))
    ).otherwise(_s(dollars))
    sign = F.when(k % 97 == 0, F.lit("$-")).otherwise(F.lit("$"))
    pick = lambda v, *labels: F.try_element_at(F.array(*[F.lit(x) for x in labels]), (v + 1).cast("int"))
    priority = F.substring("o_orderpriority", 1, 1)
    return o.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select(
        k.alias("row_id"),
        F.col("o_custkey").alias("User"),
        (k % 4).cast("int").alias("Card"),
        F.year("o_orderdate").alias("Year"),
        F.when(bad, 2).otherwise(F.month("o_orderdate")).alias("Month"),
        F.when(bad, 30).otherwise(F.day("o_orderdate")).alias("Day"),
        F.when(
            k % 503 != 0, F.concat(F.lpad(_s(k * 7 % 24), 2, "0"), F.lit(":"), F.lpad(_s(k * 13 % 60), 2, "0"))
        ).alias("Time"),
        F.concat(sign, shown, F.lit("."), F.lpad(_s(cents % 100), 2, "0")).alias("Amount"),
        F.when(priority.isin("1", "2"), "Swipe Transaction").when(priority == "3", "Chip Transaction")
        .when(priority == "4", "Online Transaction").otherwise("Manual").alias("Use Chip"),
        F.concat(F.lit("Merchant #"), _s(k % 997)).alias("Merchant Name"),
        F.concat(F.lit("City "), _s(F.col("o_custkey") % 37)).alias("Merchant City"),
        pick(F.col("c_nationkey") % 5, "CA", " ny ", "", None, "ONLINE").alias("Merchant State"),
        F.when(
            F.col("o_custkey") % 11 != 0, F.concat(_s(10000 + F.col("o_custkey") * 37 % 89999), F.lit(".0"))
        ).alias("Zip"),
        pick(k % 7, 5411, 5812, 3000, 7995, 9402, 1234, None).cast("int").alias("MCC"),
        F.when(k % 53 == 0, "Yes").when(k % 107 == 0, "1").otherwise("No").alias("Is Fraud?"),
    )


def _txn_json() -> Column:
    """A transaction as the text of a mixed JSON array of 22 entries."""
    e, t = F.col("event_id"), F.col("ts")
    q = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    tag = lambda name, k: q(F.concat(F.lit(name), _s(e % k)))
    choose = lambda k, *labels: q(F.element_at(F.array(*[F.lit(x) for x in labels]), (e % k + 1).cast("int")))
    amount = e * 31 % 100000
    with_comma = F.concat(_s(F.floor(amount / 1000)), F.lit(","), F.lpad(_s(amount % 1000), 3, "0"))
    parts = [
        tag(" addr_", 11), tag("bank_", 5), choose(5, "普", "金", "白", "钻", "X"),
        _s(F.year(t)), _s(F.month(t)), _s(F.day(t)), _s(F.hour(t)), _s(F.minute(t)), _s(F.second(t)),
        _s(F.unix_micros(t.cast("timestamp")) / F.lit(1000000.0)),
        tag("saddr_", 13), tag("sbank_", 3), q(F.col("event_type")), tag("ch_", 4), tag("pos_", 6), tag("resp_", 9),
        tag("mcc_", 17), choose(3, "直", "间", "?"), tag("Shop #", 23),
        F.when((e % 10 == 0) & (amount >= 1000), q(with_comma)).otherwise(_s(amount)),
        q(F.hex(e)), q(F.hex(e + 1)),
    ]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def record_lines(spark: SparkSession, sf: str, pieces: Column | None = None, places: bool = True) -> DataFrame:
    """``value``: one JSON line per user record. ``pieces`` numbers the records of a history by its
    rows' ``_pos`` and adds that number (``_rec``); without ``places`` records do not say where they start."""
    ev = table(spark, sf, "events").select("user_id", "event_id", "ts", _txn_json().alias("txn"))
    ev = ev.withColumn("_time", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000.0))
    ev = ordered_scan(ev, ["user_id"], [F.col("ts"), F.col("event_id")], position="_pos", previous={"_prev": "_time"})
    ev = ev.withColumn("_rec", F.floor(F.col("_pos") / RECORD_TXNS) if pieces is None else pieces)
    listed = F.expr("listagg(txn, ',') WITHIN GROUP (ORDER BY _pos)")
    first = F.struct(F.min("_pos").alias("at"), F.min_by("_prev", "_pos").alias("prev"))
    part = F.when(
        (F.col("first.at") > 0) & F.lit(places), F.concat(F.lit(',"start":'), _s(F.col("first.at")), F.lit(',"prev_ts":'), _s(F.col("first.prev")))
    ).otherwise("")
    lines = ev.groupBy("user_id", "_rec").agg(listed.alias("txns"), first.alias("first")).select(
        F.concat(
            F.lit('{"cert_sm3":"u'), _s(F.col("user_id")), F.lit('","label":'),
            F.when(F.col("user_id") % 5 == 0, "1").otherwise("0"), F.lit(',"trans":['), F.col("txns"), F.lit("]"), part, F.lit("}"),
        ).alias("value"),
        *([] if pieces is None else ["_rec"]),
    )
    return lines.unionByName(spark.createDataFrame([(r,) for r in EDGE_RECORDS], "value string"), allowMissingColumns=True)


def record_folder(spark: SparkSession, sf: str) -> str:
    """The record lines written as a folder of text files."""
    path = fresh_path(spark, "records")
    record_lines(spark, sf).write.text(path)
    return path


def records(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.readers import parse_records

    return parse_records(record_lines(spark, sf).withColumn("_file", F.lit("derived")))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        F.concat(F.lit("u"), _s(F.col("user_id"))).alias("user"),
        e,
        ((e * 37 % 101) / F.lit(101.0)).alias("p1"),
        F.when(e % 7 == 0, 1).otherwise(0).alias("label"),
        F.lit(0.0).alias("z0"),
        ((e % 41) / F.lit(10.0) - 2.0).alias("z1"),
        (e * 977 % 1000000).cast("double").alias("amount"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("vec_id") % 10
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.when(d <= 7, "train").when(d == 8, "val").otherwise("test").alias("split"),
        F.when(F.col("label") == 0, 1).otherwise(0).alias("label"),
        F.col("label").alias("group_id"),
        "embedding",
    )
