"""Nested records: reading, expanding, splitting, sharding."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions.constants import TXN_FIELDS
from ledgerspark.operators import expand
from ledgerspark.operators.history import min_history
from ledgerspark.operators.split import temporal_split_quantile
from ledgerspark.sources import readers, writers
from ledgerspark.streaming.tokens import record_rows

# Own values: a leap day, midnight, an amount with a comma, and a gap over a year's end.
T1 = ["4400", "Nordbank", "白", 2023, 12, 31, 23, 59, 59, 1704067199.0, "acq-7", "Südkasse", "refund", "kiosk", "chip, PIN",
      "declined, limit", "5999", "直", "Café 24/7 **Ü", "2,480"]
T2 = ["4400", "Nordbank", "白", 2024, 1, 1, 0, 30, 0, 1704069000.0, "acq-9", "Südkasse", "sale", "web", "keyed", "ok", "n/a", "间", "Kiosk*Ost", 7]
T3 = ["9001", "Inselbank", "X", 2024, 2, 29, 12, 0, 1, 1709208001.0, "acq-1", "Ostkasse", "sale", "web", "tap", "ok", "4111", "?", "Fähre", 0.5]
RECORDS = [{"cert_sm3": "mara", "label": 1, "trans": [T1, T2]}, {"cert_sm3": "odd", "label": 0, "trans": [T3]}]


def write(path, lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


@pytest.fixture
def folder(tmp_path):
    write(tmp_path / "a.jsonl", [json.dumps(RECORDS[0], ensure_ascii=False), "", "   "])
    write(tmp_path / "b.jsonl", [json.dumps(RECORDS[1], ensure_ascii=False)])
    write(tmp_path / "ignored.txt", ["not json"])
    (tmp_path / "sub").mkdir()
    write(tmp_path / "sub" / "c.jsonl", ["not json either"])
    return str(tmp_path)


def test_load_and_expand(spark, folder):
    records = readers.read_records(spark, folder)
    assert records.count() == 2
    df = expand.expand_records(records)
    assert df.count() == 3
    assert {n for _, n, _, _ in TXN_FIELDS} <= set(df.columns)
    assert {n for _, _, n, _ in TXN_FIELDS} <= set(expand.source_names(df).columns)
    rows = {(r["user_id"], r["seq_order"]): r for r in df.collect()}
    assert {k[0]: r["label"] for k, r in rows.items()} == {"mara": 1, "odd": 0}
    first = rows["mara", 1]
    assert (first["dow"], first["period"]) == (0, 0)
    assert first["unix_ts"] == 1704069000.0 and first["year"] == 2024 and first["amount"] == "7"


def test_a_history_in_parts_is_one_history(spark, tmp_path):
    parts = [{"cert_sm3": "p", "trans": [T1]}, {"cert_sm3": "p", "trans": [T2, T3], "start": 1, "prev_ts": T1[9]}]
    whole = [{"cert_sm3": "p", "trans": [T1, T2, T3]}]
    rows = []
    for name, lines in (("parts", parts), ("whole", whole)):
        r = readers.read_records(spark, write(tmp_path / f"{name}.jsonl", [json.dumps(x) for x in lines]))
        rows.append(sorted(map(str, record_rows(r).collect())))
        assert min_history(r, 3).count() == len(lines) and min_history(r, 4).count() == 0
    assert rows[0] == rows[1]


def test_single_file(spark, folder):
    assert readers.read_records(spark, folder + "/a.jsonl").count() == 1


def test_missing_and_empty_paths(spark, tmp_path):
    with pytest.raises(Exception):
        readers.read_records(spark, str(tmp_path / "nowhere")).count()
    (tmp_path / "x.txt").write_text("a")
    with pytest.raises(FileNotFoundError):
        readers.read_records(spark, str(tmp_path))


def test_bad_line_raises_with_its_file(spark, tmp_path):
    path = write(tmp_path / "bad.jsonl", [json.dumps(RECORDS[0]), '{"cert_sm3": oops'])
    with pytest.raises(Exception, match="Invalid JSON at .*bad.jsonl"):
        readers.read_records(spark, path).collect()
    assert readers.read_records(spark, path, strict=False).count() == 1
    assert [r["value"] for r in readers.rejected_lines(spark, path).collect()] == ['{"cert_sm3": oops']


def test_short_transaction_raises(spark, tmp_path):
    path = write(tmp_path / "s.jsonl", [json.dumps({"cert_sm3": "short", "trans": [T3[:11]]})])
    r = readers.read_records(spark, path)
    with pytest.raises(Exception, match="need >="):
        expand.expand_records(r).collect()
    assert expand.expand_records(r, strict=False).count() == 0
    assert expand.short_transactions(r).count() == 1


def test_records_without_transactions(spark, tmp_path):
    path = write(tmp_path / "e.jsonl", [json.dumps({"cert_sm3": "a", "trans": []}), json.dumps({"cert_sm3": "b"})])
    r = readers.read_records(spark, path)
    assert expand.empty_users(r).first().asDict() == {"n_dropped": 2, "n_records": 2}
    with pytest.raises(ValueError, match="no transactions"):
        expand.require_transactions(expand.expand_records(r))


def test_expanding_reads_json_once_and_does_not_shuffle(spark, folder):
    plan = expand.expand_records(readers.read_records(spark, folder))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("from_json") == 1


@pytest.mark.parametrize("ratios", [(0.6, 0.2), (0.8, 0.1)])
def test_split_adds_up(spark, folder, ratios):
    df = expand.expand_records(readers.read_records(spark, folder))
    s, (q1, q2) = temporal_split_quantile(df, "unix_ts", *ratios)
    assert s.count() == df.count() and q1 <= q2


def test_missing_time_is_in_no_split(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,), (float("nan"),)], "unix_ts double")
    assert temporal_split_quantile(df)[0].count() == 3


def test_gaps_from_the_record_itself(spark, folder):
    rows = {(r["user_id"], r["seq_order"]): r["time_delta_s"] for r in record_rows(readers.read_records(spark, folder)).collect()}
    assert rows == {("mara", 0): 0.0, ("mara", 1): 1801.0, ("odd", 0): 0.0}


def test_amount_column_is_required(spark, folder):
    df = expand.expand_records(readers.read_records(spark, folder))
    assert sorted(r[0] for r in expand.amount_series(df).collect()) == ["0.5", "2,480", "7"]
    with pytest.raises(KeyError):
        expand.amount_series(df.drop("amount"))


def test_shards_are_disjoint_and_complete(spark, tmp_path):
    df = spark.createDataFrame([(f"u{i}", j) for i in range(60) for j in range(3)], "user string, n int")
    out = writers.write_shards(df, str(tmp_path / "shards"), 2, "user")
    by = {s: {r["user"] for r in out.where(F.col("shard") == s).collect()} for s in (0, 1)}
    assert by[0].isdisjoint(by[1]) and by[0] | by[1] == {f"u{i}" for i in range(60)} and by[0] and by[1]
    assert out.count() == 180


def test_stage_builds_once_unless_forced(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "t")
    for force, want in [(False, 1), (False, 1), (True, 2)]:
        assert writers.stage(spark, path, build, force).count() == 3
        assert len(calls) == want
