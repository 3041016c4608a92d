"""Runs of an evaluation: predictions are processed, scored by all metrics in one pass, written as reports, and handed to callbacks.

A metric that can't be computed is no reason to lose the others: it is left out of the scores and named with its error in the report, never silently. What can't be planned (an unknown name, columns that
aren't there) is found before anything is run; what fails while it runs is found by running the metrics one by one, only then.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions import metrics as M
from ragloom.operators import reward

Metric = Callable[[Column, Column], Column]


class Report(NamedTuple):
    scores: dict[str, float]  # the mean of each metric; 0 for an empty table
    failed: dict[str, str]  # metrics that have none, with the error
    rows: DataFrame  # the processed rows with a column for each metric


def _means(rows: DataFrame, names: Sequence[str]) -> dict[str, float]:
    found = rows.agg(*[F.coalesce(F.avg(F.col(f"`{n}`")), F.lit(0.0)).alias(n) for n in names]).first() if names else {}
    return {n: float(found[n]) for n in names}


def run(rows: DataFrame, metrics: Sequence[str], pred: str = "pred", golds: str = "golden_answers", process: Callable[[DataFrame], DataFrame] | None = None, after: Sequence[Callable[[Report], None]] = (), path: str | None = None, extra: dict[str, Metric] | None = None) -> Report:
    """Scores ``rows`` by metrics of the registry or of ``extra``. ``process`` is applied to the rows first; each of ``after`` gets the report; with a ``path`` the report is also written there (``write``)."""
    known = {**M.REGISTRY, **(extra or {})}
    rows = rows if process is None else process(rows)
    failed: dict[str, str] = {}
    scored = rows
    for name in dict.fromkeys(metrics):
        try:
            scored = scored.withColumn(name, known[name](F.col(pred), F.col(golds)).cast("double"))
        except KeyError:
            failed[name] = "unknown metric"
        except PySparkException as error:
            failed[name] = str(error).split("\n")[0]
    names = [n for n in dict.fromkeys(metrics) if n not in failed]
    try:
        scores = _means(scored, names)
    except PySparkException:
        scores = {}
        for name in names:
            try:
                scores.update(_means(scored, [name]))
            except PySparkException as error:
                failed[name] = str(error).split("\n")[0]
        scored = scored.drop(*failed)
    report = Report(scores, failed, scored)
    if path is not None:
        write(report, path)
    for callback in after:
        callback(report)
    return report


def write(report: Report, path: str) -> None:
    """``metric_score`` as text (``name: value`` lines), ``metric_json`` as one JSON object, and ``items``, the scored rows, as JSON lines, under ``path``."""
    spark = report.rows.sparkSession
    lines = spark.createDataFrame([(f"{n}: {v}",) for n, v in report.scores.items()], "value string").coalesce(1)
    lines.write.mode("overwrite").text(f"{path}/metric_score")
    spark.createDataFrame([(json.dumps(report.scores),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metric_json")
    report.rows.write.mode("overwrite").json(f"{path}/items")


def curve(summary: DataFrame, n: str, score: str) -> DataFrame:
    """Points of a learning curve, one for each size of the training set: N, mean and deviation over its runs, and ``gain``, the rise since the size before; few, so in order."""
    points = summary.groupBy(F.col(n).alias("N")).agg(F.avg(score).alias("mean"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("std"))
    listed = points.agg(F.array_sort(F.collect_list(F.struct("N", "mean", "std"))).alias("x"))  # a point for each size
    gains = F.transform("x", lambda p, i: F.struct(p["N"].alias("N"), p["mean"].alias("mean"), p["std"].alias("std"), (p["mean"] - F.get("x", i - 1)["mean"]).alias("gain")))
    return listed.select(F.inline(gains)).orderBy("N")


#: Backends of a step's text reward: name -> function of (prompt, step) columns. Add to it to plug in a model, as a pandas or Arrow function.
BACKENDS: dict[str, Metric] = {"dummy": lambda prompt, step: F.lit(0.0)}


def text_rewards(steps: DataFrame, backend: str = "auto", order: Sequence[str] = ("scorer", "head"), prompt: str = "prompt", step: str = "step", out: str = "text_reward") -> DataFrame:
    """``steps`` with a reward of each step's text by a backend: the one named, or with ``auto`` the first of ``order`` that is plugged in, else the dummy. A named one that isn't there raises."""
    name = next((n for n in order if n in BACKENDS), "dummy") if backend == "auto" else backend
    if name not in BACKENDS:
        raise ValueError(f"no text reward backend {name}")
    return steps.withColumn(out, BACKENDS[name](F.col(prompt), F.col(step)))


def nll_backend(nll: Callable[[Column, Column], Column]) -> Metric:
    """A backend from a model's negative log-likelihood of a step after its prompt."""
    return lambda prompt, step: reward.text_reward(nll(prompt, step))
