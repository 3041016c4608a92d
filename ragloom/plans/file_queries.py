"""Queries of the file formats: tables are written in a format, read back by its reader and summed up, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.session import scratch_path
from ragloom.sources import readers, sinks
from ragloom.tables import table


def _lines(rows: DataFrame, line: Column, name: str, tasks: int | None = None) -> str:
    """Writes one line of text for each row; returns the path."""
    path = scratch_path(rows.sparkSession, name)
    lines = rows.select(line.alias("value"))
    (lines.coalesce(tasks) if tasks else lines).write.text(path)
    return path


def _json(*pairs: tuple[str, Column]) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in pairs]))


def qa_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with one or two answers, in two appended writes."""
    rows = table(spark, sf_dir, "benchmark")
    answers = F.when(F.col("item_id") % 2 == 0, F.array(F.lit("yes"), F.substring("text", 1, 9))).otherwise(F.array(F.lit("no")))
    made = rows.select("item_id", F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), answers.alias("golden_answers"), F.lit("{}").alias("metadata"))
    path = scratch_path(spark, "qa")
    sinks.json_lines(made.where("item_id % 3 = 0").drop("item_id"), path)
    sinks.json_lines(made.where("item_id % 3 <> 0").drop("item_id"), path, append=True)
    out = readers.qa(spark, path)
    return out.select("id", F.sha2("question", 256).alias("question_sha256"), F.array_join("golden_answers", "|").alias("answers"), F.col("choices").isNull().alias("no_choices"))


def corpus_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "corpus")
    sinks.corpus(table(spark, sf_dir, "documents"), path)
    return readers.corpus(spark, path).select("id", F.sha2("contents", 256).alias("contents_sha256"))


def strict_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "orders")
    sinks.json_lines(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), path)
    rows = readers.strict_json(spark, path, "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string")
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("n_customers"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def entity_cache_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines for each customer's label, the second in other letters, with blank and broken lines between them."""
    names = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("nth")).orderBy("c_custkey", "nth")
    old, new = _json(("label", F.concat(F.upper("c_name"), F.lit(" "))), ("qid", F.lit("old"))), _json(("label", F.col("c_name")), ("qid", F.concat(F.lit("Q"), "c_custkey")))
    line = F.when(F.col("nth") == 1, old).when(F.col("nth") == 2, F.when(F.col("c_custkey") % 2 == 0, "{broken").otherwise("")).when(F.col("c_custkey") % 5 != 0, new).otherwise("{}")
    return readers.entity_cache(spark, _lines(names, line, "entities", 1))


def subgraph_cache_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' triples; a triple of two parts and broken lines are dropped."""
    rows = table(spark, sf_dir, "supplier")
    triples = F.array(F.array(F.col("s_name"), F.lit("nation"), F.col("s_nationkey").cast("string")), F.array(F.lit("two"), F.lit("parts")), F.array(F.col("s_name"), F.lit("key"), F.col("s_suppkey").cast("string")))
    line = F.when(F.col("s_suppkey") % 7 == 0, F.concat(F.lit("{"), "s_name")).otherwise(_json(("key", F.col("s_name")), ("triples", triples)))
    found = readers.subgraph_cache(spark, _lines(rows, line, "subgraphs"))
    return found.select("key", F.explode("triples").alias("x")).select("key", "x.h", "x.r", "x.t")


def question_kg_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the lines in each version of the format; broken and blank lines are passed over."""
    rows = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    rich = F.array(F.struct(F.col("p_name").alias("h"), F.lit("P1").alias("pid"), F.lit("brand").alias("r"), F.col("p_brand").alias("t"), (k / 4.0).alias("score"), F.lit(2).alias("hop")))
    new = _json(("question", F.concat(F.lit("q"), k)), ("triples", rich))
    old = _json(("q", F.concat(F.lit("q"), k)), ("t", F.array(F.array(F.col("p_name"), F.lit("type"), F.col("p_type")), F.array(F.lit("short")))))
    line = F.when(k % 10 == 0, " ").when(k % 10 == 5, "{broken").when(k % 2 == 0, new).otherwise(old)
    found = readers.question_kg(spark, _lines(rows, line, "questions"))
    return found.select("question", F.explode("triples").alias("x")).select("question", "x.h", "x.pid", "x.r", "x.t", "x.score", "x.hop")


def alpha_log_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's discounts as the gate values of its steps."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_discount"))).alias("x"))
    path = scratch_path(spark, "alpha")
    sinks.json_lines(rows.select(F.col("l_orderkey").cast("string").alias("id"), F.transform("x", lambda x: x["l_discount"]).alias("alpha_values")), path)
    return readers.alpha_log(spark, path).select("id", F.col("pos").cast("long").alias("pos"), "alpha")


def key_values_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric lines: numbers, notes with a colon of their own, and lines without one."""
    rows = table(spark, sf_dir, "events")
    k = F.col("event_id")
    line = F.when(k % 3 == 0, F.concat("event_type", k, F.lit(": "), "value")).when(k % 3 == 1, F.concat(F.lit(" note"), k, F.lit(" : a:b "))).otherwise(F.lit("no mark"))
    return readers.key_values(spark, _lines(rows, line, "metrics")).select("name", "text", F.round("number", 6).alias("number"))


def human_labels_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as CSV, read back and set against the tables' own."""
    rows = table(spark, sf_dir, "labels")
    path = scratch_path(spark, "labels")
    sinks.csv(rows.select(F.concat(F.lit("d,"), "doc_id").alias("id"), (F.col("doc_id") % 4).cast("int").alias("step_index"), F.col("quality").cast("int").alias("human_label")), path)
    return readers.human_labels(spark, path).groupBy("step_index", "human_label").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last_id"))


def training_log_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines with a step and two numbers, other lines between them."""
    rows = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    line = F.when(k % 4 != 0, F.concat(F.lit("INFO step "), k, F.lit(" loss="), F.format_string("%.3f", k / 7.0 - 3), F.lit(" kl=-"), k % 5, F.lit(".5e-2"))).otherwise("loss=1 without a number of its own")
    return readers.training_log(spark, _lines(rows, line, "log")).select(F.col("step").cast("long").alias("step"), "name", F.round("value", 6).alias("value"))


def cache_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to a cache, folded to the last value of each key."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    path, folded = scratch_path(spark, "cache"), scratch_path(spark, "folded")
    sinks.cache_append(rows.where("event_id % 2 = 1"), path)
    sinks.cache_append(rows.where("event_id % 2 = 0"), path)
    sinks.compact(path, folded, spark, "user_id", "event_type", "event_id")
    return spark.read.parquet(folded)


QUERIES = {
    f.__name__: f
    for f in (
        qa_file, corpus_file, strict_file, entity_cache_file, subgraph_cache_file, question_kg_file, alpha_log_file, key_values_file, human_labels_file, training_log_file, cache_file,
    )
}

ORACLE_SQL = {
    "qa_file": "select item_id::varchar as id, sha256(text) as question_sha256, case when item_id % 2 = 0 then 'yes|' || text[1:9] else 'no' end as answers, true as no_choices from benchmark",
    "corpus_file": """
with t as (select doc_id, regexp_replace(string_split(text, chr(10))[1], '^"+|"+$', '', 'g') as title, text[strpos(text || chr(10), chr(10)) + 1:] as body from documents where doc_id is not null and text is not null)
select doc_id::varchar as id, sha256(case when title = '' then body else title || chr(10) || body end) as contents_sha256 from t""",
    "strict_file": "select o_orderstatus, count(*) as n, count(distinct o_custkey) as n_customers, round(sum(o_totalprice), 2) as total from orders group by 1",
    "entity_cache_file": "select lower(c_name) as label, case when c_custkey % 5 <> 0 then 'Q' || c_custkey else 'old' end as qid from customer",
    "subgraph_cache_file": """
select s_name as key, s_name as h, 'nation' as r, s_nationkey::varchar as t from supplier where s_suppkey % 7 <> 0
union all select s_name, s_name, 'key', s_suppkey::varchar from supplier where s_suppkey % 7 <> 0""",
    "question_kg_file": """
select 'q' || p_partkey as question, p_name as h, 'P1' as pid, 'brand' as r, p_brand as t, p_partkey / 4.0::double as score, 2 as hop from part where p_partkey % 10 in (2, 4, 6, 8)
union all select 'q' || p_partkey, p_name, '', 'type', p_type, null, 1 from part where p_partkey % 10 in (1, 3, 7, 9)""",
    "alpha_log_file": "select l_orderkey::varchar as id, row_number() over (partition by l_orderkey order by l_linenumber, l_discount) - 1 as pos, l_discount as alpha from lineitem",
    "key_values_file": """
select event_type || event_id as name, value::varchar as text, round(value, 6) as number from events where event_id % 3 = 0
union all select 'note' || event_id, 'a:b', null from events where event_id % 3 = 1""",
    "human_labels_file": "select (doc_id % 4)::int as step_index, quality::int as human_label, count(*) as n, max('d,' || doc_id) as last_id from labels group by 1, 2",
    "training_log_file": """
select o_orderkey as step, 'loss' as name, round(printf('%.3f', o_orderkey / 7.0::double - 3)::double, 6) as value from orders where o_orderkey % 4 <> 0
union all select o_orderkey, 'kl', round(-(o_orderkey % 5 + 0.5::double) / 100, 6) from orders where o_orderkey % 4 <> 0""",
    "cache_file": "select user_id, arg_max(event_type, event_id) as event_type, max(event_id) as event_id from events group by 1",
}
