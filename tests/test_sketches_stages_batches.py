"""Stored summaries, incremental refreshes, routed records, stages by digest, batches."""

import json
from collections import Counter, defaultdict
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import batches, expand, sketches, steps as S
from ledgerspark.operators.tokens import Tokens
from ledgerspark.queries import views
from ledgerspark.session import fresh_path
from ledgerspark.sources import incremental, stages


def numbers(spark, n=60_000):
    """A third of all rows lies in one part; nulls, NaN and ties."""
    x = F.col("id") * 7919 % 10_007
    v = F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 77 == 0, float("nan")).otherwise((x * x % 5003).cast("double"))
    part = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40)
    return spark.range(n).select(part.alias("part"), v.alias("v"), (F.col("id") % 2500).alias("who"), F.lit("x").alias("n_v"))


@pytest.mark.parametrize("k", [200, sketches.K])
def test_edges_of_stored_and_new_parts_are_within_the_rank_error(spark, k):
    rows = numbers(spark)
    path = fresh_path(spark, "parts")
    for half in (F.col("part") < 20, F.col("part") >= 20):
        sketches.part_summaries(rows.where(half), ["part"], ["v"], ["who"], k=k).write.mode("append").parquet(path)
    edges = sketches.edges_from_summaries(spark.read.parquet(path), "v", 20, k)
    values = sorted(r["v"] for r in rows.where("v IS NOT NULL AND NOT isnan(v)").collect())
    assert (edges[0], edges[-1]) == (values[0], values[-1]) and edges == sorted(edges)
    from bisect import bisect_left, bisect_right

    worst = max(max(bisect_left(values, e) - i / 20 * len(values), i / 20 * len(values) - bisect_right(values, e)) for i, e in enumerate(edges))
    assert worst <= sketches.rank_error(k) * len(values)
    whole = sketches.edges_from_summaries(sketches.part_summaries(rows, ["part"], ["v"], k=k), "v", 20, k)
    for a, b in zip(edges, whole):
        assert abs(bisect_left(values, a) - bisect_left(values, b)) <= 2 * sketches.rank_error(k) * len(values) + values.count(a)


def test_merged_counts_are_exact_and_distinct_counts_near(spark):
    rows = numbers(spark)
    m = sketches.merge_summaries(sketches.part_summaries(rows, ["part"], ["v"], ["who"], F.col("who") < 5)).select("*", sketches.distinct_of("who").alias("d")).first()
    assert (m["n_rows"], m["n_pos"]) == (60_000, 5 * 24) and abs(m["d"] - 2500) <= sketches.distinct_error() * 2500
    assert m["n_v"] == rows.where("v IS NOT NULL AND NOT isnan(v)").count()


def test_summaries_of_nothing(spark):
    none = numbers(spark).where("false")
    parts = sketches.part_summaries(none, ["part"], ["v"], ["who"])
    assert parts.count() == 0 and sketches.edges_from_summaries(parts, "v", 4) == []
    m = sketches.merge_summaries(parts).select("*", sketches.distinct_of("who").alias("d")).first()
    assert (m["n_rows"], m["n_v"], m["d"], m["kll_v"]) == (0, 0, 0, None)
    nulls = sketches.part_summaries(numbers(spark).withColumn("v", F.lit(None).cast("double")), ["part"], ["v"])
    assert sketches.edges_from_summaries(nulls, "v", 4) == []


def test_split_by_stored_times(spark, sf):
    rows = expand.expand_records(views.records(spark, sf)).select("user_id", "unix_ts")
    parts = sketches.part_summaries(rows.withColumn("day", F.to_date(F.timestamp_seconds("unix_ts"))), ["day"], ["unix_ts"])
    out, (q1, q2) = sketches.split_from_summaries(rows, parts)
    got = Counter(r["split"] for r in out.select("split").collect())
    n = sum(got.values())
    assert n == rows.count() and q1 <= q2
    assert abs(got["train"] / n - 0.8) <= sketches.rank_error() + 2 / n and abs(got["test"] / n - 0.1) <= sketches.rank_error() + 2 / n


def test_only_new_and_changed_files_are_read(spark, tmp_path):
    folder, asked = tmp_path / "in [1]", []
    folder.mkdir()
    write = lambda name, rows: (folder / name).write_text("".join(json.dumps({"user_id": u, "label": y}) + "\n" for u, y in rows))

    def read(paths):
        asked.append(sorted(p.rsplit("/", 1)[1] for p in paths))
        return spark.read.schema("user_id string, label int").json(paths)

    kept = incremental.FileSummaries(spark, tmp_path.as_uri(), fresh_path(spark, "store"), read, "*.json", ["label"], ["user_id"], F.col("label") == 1)
    with pytest.raises(FileNotFoundError):
        kept.parts()
    assert kept.refresh() == []
    write("a.json", [("u1", 1), ("u2", 0)])
    write("b b.json", [("u1", 0)])
    (folder / "none.json").write_text("\n")
    kept.refresh()
    total = lambda: kept.total().select("n_files", "n_rows", "n_pos", sketches.distinct_of("user_id").alias("d")).first()
    assert tuple(total()) == (3, 3, 1, 2)
    assert kept.refresh() == [] and len(asked) == 1
    write("c.json", [("u3", 1)])
    kept.refresh()
    assert asked[1:] == [["c.json"]] and tuple(total()) == (4, 4, 2, 3)
    write("a.json", [("u1", 1), ("u2", 0), ("u4", 1)])
    kept.refresh()
    assert asked[2:] == [["a.json"]] and tuple(total()) == (4, 5, 3, 4)
    # The stored row of a file that lies there no longer is left out.
    elsewhere = incremental.FileSummaries(spark, (tmp_path / "other").as_uri(), kept.store, read, "*.json")
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "a.json").write_text("{}\n")
    assert elsewhere.parts().count() == 0


def test_records_are_routed_in_one_scan(spark):
    txn = lambda n: [str(i) for i in range(n)]
    good = ["a", "b", "普", "2024", "1", "9", "9", "5", "0", "1704791100.0", "s", "t", "v", "c", "p", "r", "m", "直", "Shop", "25", "x", "y"]
    rows = [("u1", 1, [good, txn(3), None]), ("u2", 0, []), ("u3", None, None), ("u4", 0, [good, good])]
    records = spark.createDataFrame(rows, "cert_sm3 string, label int, trans array<array<string>>").repartition(3)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    path = fresh_path(spark, "routed")
    counts = expand.route_records(records.mapInArrow(count, records.schema), path)
    assert counts == {"kept": 3, "short": 2, "empty": 2} and seen.value == 4
    kept = expand.routed(spark, path, "kept")
    want = expand.expand_records(records, strict=False)
    assert kept.columns == want.columns and sorted(map(tuple, kept.collect())) == sorted(map(tuple, want.collect()))
    short = {(r["user_id"], r["seq_order"], len(r["txn"] or [])) for r in expand.routed(spark, path, "short").collect()}
    assert short == {("u1", 1, 3), ("u1", 2, 0)}
    assert {r["user_id"] for r in expand.routed(spark, path, "empty").collect()} == {"u2", "u3"}
    assert expand.route_records(records.where("false"), fresh_path(spark, "routed")) == {"kept": 0, "short": 0, "empty": 0}


@pytest.mark.parametrize("content", [False, True])
def test_a_change_rebuilds_the_stages_below_it(spark, tmp_path, content):
    for name in ("left", "right"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.txt").write_text("1\n2\n3\n")
    root = fresh_path(spark, "stages")

    def run(least=2, version=1, force=()):
        read = lambda s, _, paths: s.read.text(*paths).select(F.col("value").cast("int").alias("v"))
        left = stages.Stage("left", read, [str(tmp_path / "left")], content=content)
        right = stages.Stage("right", read, [str(tmp_path / "right")], content=content)
        cut = stages.Stage("cut", lambda s, p, _: p[0].where(F.col("v") >= least), parents=[left], params={"least": least})
        both = stages.Stage("both", lambda s, p, _: p[0].unionByName(p[1]), parents=[cut, right], version=version)
        out, built = stages.run_stages(spark, both, root, force)
        return sorted(r["v"] for r in out.collect()), built

    assert run() == ([1, 2, 2, 3, 3], ["left", "cut", "right", "both"])
    assert run()[1] == []
    assert run(least=3) == ([1, 2, 3, 3], ["cut", "both"])
    assert run()[1] == []  # the earlier output is still there
    assert run(version=2)[1] == ["both"]
    # One byte, of the same size.
    (tmp_path / "right" / "a.txt").write_text("1\n2\n9\n")
    assert run() == ([1, 2, 2, 3, 9], ["right", "both"])
    (tmp_path / "left" / "b.txt").write_text("4\n")
    assert run() == ([1, 2, 2, 3, 4, 9], ["left", "cut", "both"])
    assert run(force=("cut",))[1] == ["cut", "both"]
    if content:
        (tmp_path / "left" / "b.txt").write_text("4\n")
        assert run()[1] == []


def test_half_written_stage_is_built_again(spark, tmp_path):
    import pathlib

    root = fresh_path(spark, "stages")
    one = stages.Stage("one", lambda s, p, _: s.range(5))
    half = pathlib.Path(root) / "one" / stages.stage_digest(spark, one)
    half.mkdir(parents=True)
    (half / "part-0.parquet").write_text("broken")
    out, built = stages.run_stages(spark, one, root)
    assert built == ["one"] and out.count() == 5


@pytest.mark.parametrize("hot_rows", [100, 200_000])
def test_every_sample_is_in_one_batch_within_the_budget(spark, hot_rows):
    # A third of all samples have one length; nulls, zeros, too long ones, repeated ids.
    n = F.when(F.col("id") % 3 == 0, 17).when(F.col("id") % 101 == 0, None).otherwise(F.col("id") * 31 % 140)
    samples = spark.range(3000).select((F.col("id") % 2900).alias("who"), n.cast("int").alias("n"), F.lit("w").alias("place_of"))
    dealt = batches.assign_batches(samples, "who", "n", 600, 100, hot_rows=hot_rows)
    rows = dealt.collect()
    real = lambda x: min(max(x or 1, 1), 100)
    assert Counter((r["who"], r["n"]) for r in rows) == Counter((r["who"], r["n"]) for r in samples.collect())
    held = defaultdict(list)
    for r in rows:
        held[r["width"], r["batch"]].append(r)
        assert real(r["n"]) <= r["width"]
    for (width, _), members in held.items():
        assert len(members) * width <= 600 and sorted(r["place"] for r in members) == list(range(len(members)))
        assert len({r["batch_key"] for r in members}) == 1
    for width in {w for w, _ in held}:
        sizes = [len(held[w, b]) for w, b in sorted(held) if w == width]
        assert all(s == 600 // width for s in sizes[:-1])
    share = batches.padding_share(dealt, "n", 100).first()
    padded = sum(len(m) * max(real(r["n"]) for r in m) for m in held.values())
    assert share["n_samples"] == 3000 and share["n_batches"] == len(held)
    assert share["share"] == pytest.approx(1 - sum(real(r["n"]) for r in rows) / padded) and share["share"] < 0.1 < share["fixed_share"]
    other = batches.assign_batches(samples, "who", "n", 600, 100, epoch=1, hot_rows=hot_rows).collect()
    assert {(r["who"], r["width"], r["batch"]) for r in other} != {(r["who"], r["width"], r["batch"]) for r in rows}
    assert batches.assign_batches(samples.where("false"), "who", "n", 600, 100).count() == 0
    with pytest.raises(ValueError):
        batches.assign_batches(samples, "who", "n", 99, 100)


def test_batches_are_padded_to_their_longest(spark):
    txn = [[1, 5, 2, 0]]
    rows = [(f"u{i}", txn * k, [[1, 1, 1, 0]] * k, list(range(k)), [0] * k, k, i % 2, 1.0) for i, k in enumerate([1, 2, 3, 3, 9, 12])]
    types = "user_id string, input_ids array<array<int>>, attention_mask array<array<int>>, his_time_stap array<bigint>, delta_time_stap array<bigint>, lens_in int, label int, amount double"
    samples = spark.createDataFrame(rows, types)
    columns = [c for c in samples.columns if c != "lens_in"]
    out = batches.pad_batches(batches.gather_batches(batches.assign_batches(samples, "user_id", "lens_in", 24, 10), columns), 4)
    for b in out.collect():
        assert b["n"] == len(b["rows"]) and b["pad_to"] == max(r["lens_in"] for r in b["rows"]) and b["n"] * b["pad_to"] <= 24
        for r in b["rows"]:
            assert all(len(r[c]) == b["pad_to"] for c in ("input_ids", "attention_mask", "step_mask", "his_time_stap", "delta_time_stap"))
            assert sum(r["step_mask"]) == r["lens_in"] and r["input_ids"][r["lens_in"]:] == [[0] * 4] * (b["pad_to"] - r["lens_in"])
    assert sorted(r["user_id"] for b in out.collect() for r in b["rows"]) == [f"u{i}" for i in range(6)]


@dataclass(frozen=True)
class ParityStep(S.NumberedStep):
    """A caller's own step: odd or even."""

    size = 2

    def index(self):
        return F.pmod(F.col(self.column), F.lit(2)).cast("int")


def test_own_steps_survive_save_and_load(spark):
    df = spark.createDataFrame([(1,), (4,)], "n int")
    own = Tokens((ParityStep("n", "ODD"),)).fit(df)
    path = fresh_path(spark, "own")
    own.save(spark, path)
    with pytest.raises(ValueError, match="ParityStep"):
        Tokens.load(spark, path)
    back = Tokens.load(spark, path, classes=(ParityStep,))
    assert [s for s in back.steps] == [s for s in own.steps] and isinstance(back.steps[0], ParityStep)
