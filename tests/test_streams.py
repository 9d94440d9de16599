"""Keyed state of streams against one scan over the whole history."""

import random

import pytest

from ledgerspark.operators.history import with_gap
from ledgerspark.session import fresh_path
from ledgerspark.streaming.gaps import carry_gaps
from pyspark.sql import functions as F

SCHEMA = "who long, at double, id long, note string, list array<int>, part struct<a: int, b: string>, day date, flag boolean, pos string"


def row(who, at, id, note=None):
    return (who, at, id, note, [id % 3, None], (id % 100, note), None, None if id % 2 else True, "old")


def run(spark, deliveries, per_run=True, **kw):
    """Deliver and drain one by one, each from the checkpoint of the one before."""
    folder, out, checkpoint = (fresh_path(spark, x) for x in "abc")
    spark.createDataFrame([], SCHEMA).write.parquet(folder)
    for rows in deliveries:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = carry_gaps(spark.readStream.schema(SCHEMA).parquet(folder), ["who"], "at", ["id"], **kw)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(out)


def test_pieces_give_the_gaps_of_the_whole(spark):
    r = random.Random(4)
    big = 2**60
    rows = sorted((row(r.choice([1, 2, None, big + 1]), float(r.randint(0, 300)) / 4, big + k, "x") for k in range(200)), key=lambda x: (x[1], x[2]))
    rows += [row(1, None, big + 500), row(7, None, big + 501), row(7, None, big + 502)]
    got = run(spark, [rows[:60], rows[60:61], rows[61:]])
    whole = spark.createDataFrame(rows, SCHEMA)
    want = with_gap(whole.drop("pos"), ["who"], [F.col("at").isNull(), F.col("at"), F.col("id")], "at", position="pos")
    cols = ["who", "at", "id", "note", "list", "part", "day", "flag", "pos", "time_delta_s"]
    assert sorted(map(repr, got.where(~F.col("late")).select(cols).collect())) == sorted(map(repr, want.select(cols).collect()))
    assert dict(got.dtypes)["pos"] == "bigint" and dict(got.dtypes)["part"] == dict(whole.dtypes)["part"]


def test_late_rows_are_kept_and_marked(spark):
    got = run(spark, [[row(1, 10.0, 1), row(1, 20.0, 2)], [row(1, 12.0, 3), row(1, 26.0, 4), row(2, 1.0, 5)]])
    assert sorted((r["id"], r["pos"], r["time_delta_s"], r["late"]) for r in got.collect()) == [
        (1, 0, 0.0, False), (2, 1, 10.0, False), (3, 2, 0.0, True), (4, 3, 6.0, False), (5, 0, 0.0, False)
    ]


@pytest.mark.parametrize("seconds, place", [(0.001, 0), (3600, 1)])
def test_expiry(spark, seconds, place):
    got = run(spark, [[row(1, 10.0, 1)], [row(1, 20.0, 2)]], expire_seconds=seconds)
    assert {r["id"]: (r["pos"], r["time_delta_s"]) for r in got.collect()} == {1: (0, 0.0), 2: (place, 10.0 * place)}


def test_many_keys_share_few_states(spark):
    """A Python group and a state per key made large tables too slow."""
    folder, out, checkpoint = (fresh_path(spark, x) for x in "abc")
    rows = spark.range(6000).select((F.col("id") % 2000).alias("who"), (F.col("id") % 2000 + F.floor(F.col("id") / 2000) * 5).cast("double").alias("at"), "id")
    for k in range(2):
        rows.where(F.floor(F.col("id") / 4000) == k).write.mode("append").parquet(folder)
        stream = carry_gaps(spark.readStream.schema(rows.schema).parquet(folder), ["who"], "at", ["id"], buckets=16)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 16
    got = spark.read.parquet(out)
    wrong = (F.col("pos") != F.floor(F.col("id") / 2000)) | (F.col("time_delta_s") != F.when(F.col("id") < 2000, 0).otherwise(5)) | F.col("late")
    assert got.count() == 6000 and got.where(wrong).count() == 0


def test_record_lines_are_built_once(spark, sf, monkeypatch):
    """Every delivery used to build all records anew."""
    from ledgerspark.queries import histories, views

    built, real = spark.sparkContext.accumulator(0), views.record_lines

    def counted(rec):
        built.add(1)
        return rec

    def lines(*args, **kw):
        return real(*args, **kw).withColumn("_rec", F.udf(counted, "long")("_rec"))

    monkeypatch.setattr(views, "record_lines", lines)
    histories.stream_time_delta_user(spark, sf)
    assert built.value == real(spark, sf, pieces=F.floor(F.col("_pos") / 20), places=False).count()
