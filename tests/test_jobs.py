"""The end-to-end jobs on derived files."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators.split import temporal_split_quantile
from ledgerspark.operators.vectors import one_hot_states
from ledgerspark.plans import jobs
from ledgerspark.queries import views
from ledgerspark.sources import readers


def test_card_job(spark, sf, tmp_path):
    views.card(spark, sf).write.option("header", True).csv(str(tmp_path / "csv"))
    out = jobs.run_card_job(spark, str(tmp_path / "csv"), str(tmp_path / "out"), chunk_size=5)
    dated = views.card(spark, sf).where("row_id % 1009 <> 0").count()
    assert out["splits"].count() == dated == out["stats"].agg(F.sum("n_txns")).first()[0]
    lines = spark.read.text(str(tmp_path / "out" / "corpus"))
    assert lines.count() == out["sequences"].count() and lines.where("value not like '<bos> % <eos>'").count() == 0


def test_ndjson_job(spark, sf, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [r["value"] for r in views.record_lines(spark, sf).collect()]
    (folder / "a.jsonl").write_text("\n".join(lines), encoding="utf-8")
    out = jobs.run_ndjson_job(spark, str(folder), str(tmp_path / "out"), chunk_size=20)
    n = sum(len(json.loads(x)["trans"]) for x in lines)
    assert out["transactions"].count() == n == out["sequences"].agg(F.sum("n_txns")).first()[0]
    want = {(r["split"], r["line_idx"]): r for r in out["sequences"].collect()}
    seen = 0
    for split in ("train", "val", "test"):
        text, side = (in_file_order(tmp_path / "out" / part / f"split={split}") for part in ("corpus", "sidecar"))
        assert len(text) == len(side)
        for i, (line, meta) in enumerate(zip(text, map(json.loads, side))):
            r = want[split, i]
            assert line == r["text"] and line.count("<sep>") + 1 == meta["n_txns"]
            assert (meta["line_idx"], meta["user_id"], meta["chunk_id"], meta["label"]) == (i, r["user_id"], r["chunk_id"], r["label"])
        seen += len(text)
    assert seen == len(want)
    written = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("part-*")}
    again = jobs.run_ndjson_job(spark, str(folder), str(tmp_path / "out"), chunk_size=20)
    assert again["tokens"] == out["tokens"]
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("part-*")} == written
    other = jobs.run_ndjson_job(spark, str(folder), str(tmp_path / "other"), chunk_size=20)
    keys = lambda o: sorted(r["row_id"] for r in o["transactions"].select("row_id").collect())
    assert keys(other) == keys(out) and len(set(keys(out))) == n
    report = jobs.run_report_job(
        spark, temporal_split_quantile(out["transactions"])[0], str(tmp_path / "report"), "ndjson", out["tokens"], one_hot_states(8), k=3,
        settings={k: dict(rounds=2, depth=2) for k in ("raw", "embed", "combined")}, balanced_total=500,
    )
    assert report["vectors"].count() > 0 and report["metadata"].count() == 3
    assert [r["feature_dim"] for r in report["metrics"].orderBy("feature_dim").collect()] == [3, 14, 17]


def in_file_order(folder):
    return [line for f in sorted(folder.glob("part-*")) for line in f.read_text(encoding="utf-8").splitlines()]


HEADER = "User,Card,Year,Month,Day,Time,Amount,Use Chip,Merchant Name,Merchant City,Merchant State,Zip,MCC,Errors?,Is Fraud?"


def test_card_files_are_read_by_their_header(spark, tmp_path):
    line = '7,1,2019,3,9,14:05,"$1,250.75",Chip Transaction,Shop 9,Ulm,,,5411,,No'
    (tmp_path / "a.csv").write_text("\n".join([HEADER, line, line]) + "\n")
    df = readers.read_card_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == HEADER.split(",") and df.first()["MCC"] == 5411 and df.first()["Amount"] == "$1,250.75"
    keys = lambda: sorted(r["row_id"] for r in readers.with_row_key(df).collect())
    assert keys() == keys() and len(set(keys())) == 2
    (tmp_path / "b.csv").write_text("User,Card\n1,2\n")
    with pytest.raises(ValueError, match="missing"):
        readers.read_card_csv(spark, str(tmp_path / "b.csv"))
    out = jobs.run_card_job(spark, str(tmp_path / "a.csv"), str(tmp_path / "out"))
    assert out["splits"].count() == 2


def test_compare_models(spark, sf):
    raw = views.card(spark, sf).withColumn("split", F.when(F.col("row_id") % 10 <= 7, "train").when(F.col("row_id") % 10 == 8, "val").otherwise("test"))
    s = dict(rounds=2, depth=2)
    r = jobs.compare_models(raw, views.vectors(spark, sf), ["Hour", "Amount", "Use Chip", "MCC"], 4, {k: s for k in ("raw", "embed", "combined")})
    assert [x["feature_dim"] for x in r.orderBy("pos").collect()] == [4, 4, 8]
