"""Evaluation runs: hooks, callbacks, failing metrics, reports."""

import pytest
from pyspark.sql import functions as F

from ragloom.operators.ranks import batched
from ragloom.plans import evaluation
from ragloom.sources import readers


def rows_of(spark):
    return spark.createDataFrame([(1, "The cat", ["cat"]), (2, "dog!", ["cat", "dogs"]), (3, None, ["x"])], "id int, pred string, golden_answers array<string>")


def test_failing_metrics_are_named_and_the_others_kept(spark, tmp_path):
    seen = []
    extra = {"at_run": lambda p, g: F.when(F.length(p) > 0, F.raise_error(F.lit("bad row"))).otherwise(0.0), "no_column": lambda p, g: F.col("missing"), "one": lambda p, g: F.lit(1)}
    path = str(tmp_path / "run")
    report = evaluation.run(rows_of(spark), ["em", "at_run", "no_column", "unknown", "one", "em"], after=[seen.append, lambda r: seen.append(len(r.failed))], path=path, extra=extra)
    assert report.scores == {"em": pytest.approx(1 / 3), "one": 1.0} and set(report.failed) == {"at_run", "no_column", "unknown"} and seen == [report, 3]
    assert "bad row" in report.failed["at_run"] or "at_run" in report.failed
    assert sorted((r.name, r.number) for r in readers.key_values(spark, f"{path}/metric_score").collect()) == [("em", pytest.approx(1 / 3)), ("one", 1.0)]
    items = {r.id: r.em for r in spark.read.schema("id int, em double").json(f"{path}/items").collect()}
    assert items == {1: 1.0, 2: 0.0, 3: 0.0}


def test_process_and_empty_table(spark):
    upper = lambda r: r.withColumn("pred", F.lit("cat"))
    assert evaluation.run(rows_of(spark), ["em"], process=upper).scores == {"em": pytest.approx(2 / 3)}
    assert evaluation.run(rows_of(spark).limit(0), ["em", "f1"]).scores == {"em": 0.0, "f1": 0.0}
    assert evaluation.run(rows_of(spark), []).scores == {}


def test_backends(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "BACKENDS", dict(evaluation.BACKENDS))
    steps = spark.createDataFrame([("p", "abc")], "prompt string, step string")
    assert evaluation.text_rewards(steps).first().text_reward == 0.0
    with pytest.raises(ValueError):
        evaluation.text_rewards(steps, "head")
    evaluation.BACKENDS["head"] = lambda prompt, step: F.length(step) * 1.0
    assert evaluation.text_rewards(steps).first().text_reward == evaluation.text_rewards(steps, "head").first().text_reward == 3.0


def test_batches_and_curve(spark):
    got = batched(spark.range(23).withColumn("rank", F.lit("kept")), 5, [F.col("id").desc()])
    assert {r.id: r.batch for r in got.collect()} == {i: (22 - i) // 5 for i in range(23)} and "rank" in got.columns
    points = evaluation.curve(spark.createDataFrame([(10, 0.5), (10, 0.7), (5, 0.4)], "n int, f1 double"), "n", "f1").collect()
    assert [(r.N, r.mean, r.gain) for r in points] == [(5, 0.4, None), (10, pytest.approx(0.6), pytest.approx(0.2))]
