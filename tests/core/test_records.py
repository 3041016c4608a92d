"""Keyed streams with restarts, counted writes and tests by group."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ragloom.operators import joins, kg, stats
from ragloom.sources import sinks
from ragloom.streaming import folds


def test_keyed_stream_over_files_and_a_restart(spark, tmp_path):
    rng = random.Random(2)
    source, base = str(tmp_path / "in"), str(tmp_path / "fold")
    schema = "user int, ts timestamp, n int, v double"
    rows = []

    def add(files):
        for _ in range(files):
            new = [(rng.randint(0, 20), datetime.datetime(2024, 1, 1, rng.randint(0, 5)), len(rows) + i, None if rng.random() < 0.2 else float(rng.randint(0, 9))) for i in range(30)]
            rows.extend(new)
            spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(source)
        got = {r.user: r.v for r in folds.last_wins(stream, "user", "v", ["ts", "n"], base).collect()}
        assert got == {u: max((r for r in rows if r[0] == u), key=lambda r: r[1:3])[3] for u in {r[0] for r in rows}}
        return spark.read.parquet(f"{base}/changes")

    add(6)
    first = run()
    assert first.select("batch").distinct().count() == 6
    # A batch holds what it changed, no more: at most one row for each key, and less than a copy of the whole table in each.
    assert first.groupBy("batch", "user").count().where("count > 1").isEmpty() and first.count() < 6 * 21
    add(4)
    again = run()
    assert again.select("batch").distinct().count() == 10 and {tuple(r) for r in first.collect()} <= {tuple(r) for r in again.collect()}


def test_bootstrap_by_group_equals_one_of_each(spark):
    rng = random.Random(3)
    rows = [(i, g, m, rng.random() + (0.2 if g == "x" else 0), rng.random() if rng.random() < 0.9 else None) for i in range(60) for g in "xy" for m in (1, None)]
    df = spark.createDataFrame(rows, "id int, g string, m int, a double, b double")
    got = {(r.g, r.m): r for r in stats.paired_bootstrap_by(df.repartition(5), ["g", "m"], "id", "a", "b", 400).collect()}
    assert len(got) == 4
    for (g, m), r in got.items():
        own = df.where((F.col("g") == g) & F.col("m").eqNullSafe(F.lit(m)))
        one = stats.paired_bootstrap(own, "id", "a", "b", 400).first()
        assert [r[c] for c in ("low", "high", "p", "mean_diff")] == pytest.approx([one[c] for c in ("low", "high", "p", "mean_diff")], abs=1e-12)
        assert r.n == own.where("b is not null").count()
    assert stats.paired_bootstrap_by(df.limit(0), ["g"], "id", "a", "b", 10).collect() == []


def test_adjusted_p_values(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5), ("e", None)], "t string, p double").withColumn("place", F.lit("kept"))
    got = {r.t: (r.p_holm, r.p_bh, r.place) for r in stats.adjusted(df).collect()}
    wanted = {"a": (0.04, 0.04), "b": (0.09, 0.16 / 3), "c": (0.09, 0.16 / 3), "d": (0.5, 0.5), "e": (None, None)}
    assert {t: x[:2] for t, x in got.items()} == {t: pytest.approx(x) if x[0] is not None else x for t, x in wanted.items()} and {x[2] for x in got.values()} == {"kept"}


def test_counts_of_a_write(spark, tmp_path):
    rows = [(1, "Title\nbody"), (2, '"Quoted"\nbody'), (3, '""\nno title'), (4, None), (None, "x"), (6, ""), (6, "One line")]
    path = str(tmp_path / "corpus")
    scans = spark.sparkContext.accumulator(0)
    base = spark.createDataFrame(rows, "doc_id long, text string").rdd.map(lambda r: (scans.add(1), r)[1])
    counts = sinks.corpus(spark.createDataFrame(base, "doc_id long, text string"), path)
    assert counts == {"read": 7, "written": 5, "skipped": 2, "repaired": 3} and scans.value == 7  # one pass
    got = sorted((r.id, r.contents) for r in spark.read.schema("id string, contents string").json(path).collect())
    assert got == sorted([("1", "Title\nbody"), ("2", "Quoted\nbody"), ("3", "no title"), ("6", ""), ("6", "One line\n")])


def test_context_confidence_of_missing_parts(spark):
    steps = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, ["z"]), (4, ["a"])], "key int, entities array<string>")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [-1.0, 0.0])], "entity string, v array<double>")
    contexts = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0])], "key int, v array<double>")
    exact = spark.createDataFrame([("a", 0.7)], "entity string, confidence double")
    got = {r.key: r.confidence for r in joins.context_confidence(steps, vectors, contexts, exact).collect()}
    assert got == {1: pytest.approx(2 / 3), 2: 0.0, 3: 0.0, 4: 0.7}


def test_overrides_come_before_decisions(spark):
    decisions = spark.createDataFrame([("Big  Gap", "Q1", 0.4, 0.2, None), ("low", None, 0.1, 0.1, "low score")], "mention string, entity_id string, score double, margin double, abstained string")
    mentions = spark.createDataFrame([("Big  Gap", ["x", "film"]), ("low", None), ("none", ["film"])], "mention string, expected_types array<string>")
    table = spark.createDataFrame([("big gap", "film", "F"), ("big gap", "default", "D"), ("low", "film", "L")], "mention string, kind string, entity_id string")
    got = {r.mention: (r.entity_id, r.score, r.abstained) for r in kg.overridden(decisions, mentions, table).collect()}
    assert got == {"Big  Gap": ("F", 0.95, None), "low": (None, 0.1, "low score"), "none": (None, None, "no candidates")}
