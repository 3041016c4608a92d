"""Sinks: rows by Spark's writers; only small reports are rendered on the driver, from tables of a bounded size."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ragloom.functions import text as X

#: Rows of a table that a report may render.
REPORT_ROWS = 1000


def json_lines(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def counted(rows: DataFrame, path: str, counts: dict[str, Column], kept: Column | None = None, columns: list[str] | None = None, kind: str = "json") -> dict[str, int]:
    """Writes ``columns`` of the rows for which ``kept`` holds; returns how many rows were ``read`` and ``written``, and for how many, kept or not, each of ``counts`` holds.

    All are observed by the plan that writes, so there is no second pass.
    """
    kept = F.lit(True) if kept is None else F.coalesce(kept, F.lit(False))
    seen = Observation()
    observed = rows.observe(seen, F.count(F.lit(1)).alias("read"), F.count_if(kept).alias("written"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()])
    observed.where(kept).select(*(columns or rows.columns)).write.mode("overwrite").format(kind).save(path)
    return seen.get


def corpus(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> dict[str, int]:
    """Documents as passages in JSON lines: ``id`` and ``contents``, the first line as title without quotes around it, a line feed and the rest, or the rest alone without a title.

    Returns ``read``, ``written``, ``skipped`` (no id or no text) and ``repaired`` (written with another title than its line, or with none).
    """
    line, body = X.title_of(F.col(text_col)), X.body_of(F.col(text_col))
    title = F.regexp_replace(line, '^"+|"+$', "")
    contents = F.when(title == "", body).otherwise(F.concat(title, F.lit("\n"), body))
    usable = F.col(id_col).isNotNull() & F.col(text_col).isNotNull()
    rows = docs.select(F.col(id_col).cast("string").alias("id"), contents.alias("contents"), usable.alias("usable"), ((title != line) | (title == "")).alias("repaired"))
    kept = F.col("usable")
    return counted(rows, path, {"skipped": ~kept, "repaired": kept & F.col("repaired")}, kept, ["id", "contents"])


def cache_append(rows: DataFrame, path: str) -> None:
    """Append to a cache; readers fold it to the last value of each key."""
    rows.write.mode("append").parquet(path)


def compact(path_from: str, path_to: str, spark, key: str, value: str, order: str) -> None:
    """Fold an append-only cache to one row for each key."""
    rows = spark.read.parquet(path_from).groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))
    rows.write.mode("overwrite").parquet(path_to)


def csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def markdown(rows: DataFrame) -> str:
    """A small table as Markdown; more than ``REPORT_ROWS`` rows raise."""
    found = rows.limit(REPORT_ROWS + 1).collect()
    if len(found) > REPORT_ROWS:
        raise ValueError(f"a report has at most {REPORT_ROWS} rows")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in found])


def mean_std_pivot(rows: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """``mean ± std`` by row and column."""
    cells = rows.groupBy(row).pivot(column, columns).agg(F.format_string("%.4f ± %.4f", F.avg(value), F.coalesce(F.stddev_samp(value), F.lit(0.0))))
    return cells.orderBy(row)


def manifest(spark, path: str, run: dict) -> None:
    """A run's manifest as one JSON line, written where Spark writes."""
    spark.createDataFrame([(json.dumps({"schema_version": 1, "spark": spark.version, "run": run}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
