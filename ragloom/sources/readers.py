"""Scans of the file formats that retrieval and training runs leave behind. All take a path that Spark can read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QA = "id string, question string, golden_answers array<string>, choices array<string>, metadata string"
TRIPLES = "array<array<string>>"


def qa(spark: SparkSession, path: str) -> DataFrame:
    """Questions, one JSON object a line."""
    return spark.read.schema(QA).json(path)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Passages from JSON lines or Parquet; ``contents`` falls back on ``text``."""
    rows = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.schema("id string, contents string, title string, text string").json(path)
    columns = set(rows.columns)
    contents = F.coalesce(*[F.col(c) for c in ("contents", "text") if c in columns])
    return rows.withColumn("contents", contents)


def strict_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a malformed one fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def entity_cache(spark: SparkSession, path: str) -> DataFrame:
    """label, qid: blank and malformed lines are passed over; of a label's lines the last one in its file counts."""
    lines = spark.read.schema("label string, qid string, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    # Splits of a file needn't be numbered in their order, so its place in the file comes first.
    rows = lines.withColumn("at", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    rows = rows.where("_corrupt_record is null and label is not null").withColumn("label", F.lower(F.trim("label")))
    return rows.groupBy("label").agg(F.max_by("qid", "at").alias("qid"))


def subgraph_cache(spark: SparkSession, path: str) -> DataFrame:
    """key, triples: malformed lines and triples without three parts are dropped."""
    lines = spark.read.schema(f"key string, triples {TRIPLES}").option("mode", "DROPMALFORMED").json(path)
    three = F.transform(F.filter("triples", lambda t: F.size(t) == 3), lambda t: F.struct(t[0].alias("h"), t[1].alias("r"), t[2].alias("t")))
    return lines.where("key is not null").select("key", three.alias("triples"))


def question_kg(spark: SparkSession, path: str) -> DataFrame:
    """question, triples from an index of either version: rich triples, or lists of three."""
    rich = "array<struct<h:string,pid:string,r:string,t:string,score:double,hop:int>>"
    lines = spark.read.text(path).where("trim(value) <> ''")
    new = lines.select(F.from_json("value", f"question string, triples {rich}").alias("x")).where("x.question is not null and x.triples is not null").select("x.*")
    old = lines.select(F.from_json("value", f"q string, t {TRIPLES}").alias("x")).where("x.q is not null")
    plain = F.transform(
        F.filter("x.t", lambda t: F.size(t) == 3),
        lambda t: F.struct(t[0].alias("h"), F.lit("").alias("pid"), t[1].alias("r"), t[2].alias("t"), F.lit(None).cast("double").alias("score"), F.lit(1).alias("hop")),
    )
    return new.unionByName(old.select(F.col("x.q").alias("question"), plain.alias("triples")))


def alpha_log(spark: SparkSession, path: str) -> DataFrame:
    """One row for each logged gate value."""
    return spark.read.schema("id string, alpha_values array<double>").json(path).select("id", F.posexplode("alpha_values").alias("pos", "alpha"))


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """``name: value`` lines: name, text, and the number where it is one."""
    parts = F.split("value", ":", 2)
    rows = spark.read.text(path).where(F.contains("value", F.lit(":")))
    return rows.select(F.trim(parts[0]).alias("name"), F.trim(parts[1]).alias("text")).withColumn("number", F.expr("try_cast(text as double)"))


def newest_metrics(spark: SparkSession, path: str) -> DataFrame:
    """method, dataset, seed and metrics of runs at ``method/dataset/seed_N/.../metric_score.json``; of several files of a run the last by path."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "metric_score.json").option("wholetext", "true").text(path)
    rows = files.select("value", F.col("_metadata.file_path").alias("file"))
    pattern = r"([^/]+)/([^/]+)/seed_([0-9]+)/"
    keyed = rows.select(*[F.regexp_extract("file", pattern, i).alias(n) for i, n in ((1, "method"), (2, "dataset"), (3, "seed"))], "file", "value").where("seed <> ''")
    last = keyed.groupBy("method", "dataset", F.col("seed").cast("int").alias("seed")).agg(F.max_by("value", "file").alias("value"))
    return last.withColumn("metrics", F.from_json("value", "map<string,double>")).drop("value")


def human_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, step_index int, human_label int").option("header", "true").csv(path)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions as a JSON list, bare or under ``data``."""
    item = "struct<id:string,question:string,pred:string,golden_answers:array<string>>"
    whole = spark.read.option("wholetext", "true").text(path)
    items = F.coalesce(F.from_json("value", f"struct<data:array<{item}>>")["data"], F.from_json("value", f"array<{item}>"))
    return whole.select(F.explode(items).alias("x")).select("x.*")


def training_log(spark: SparkSession, path: str) -> DataFrame:
    """step and the ``name=number`` pairs of a text log's lines."""
    lines = spark.read.text(path).where(F.rlike("value", F.lit(r"step[ =]+[0-9]+")))
    names, numbers = (F.regexp_extract_all("value", F.lit(r"([a-z_]+)=(-?[0-9.]+(?:e-?[0-9]+)?)"), F.lit(i)) for i in (1, 2))
    rows = lines.select(F.regexp_extract("value", r"step[ =]+([0-9]+)", 1).cast("int").alias("step"), F.explode(F.arrays_zip(names.alias("name"), numbers.alias("number"))).alias("x"))
    return rows.select("step", F.col("x.name").alias("name"), F.expr("try_cast(x.number as double)").alias("value")).where("name <> 'step'")
