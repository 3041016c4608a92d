"""Queries of the agent loops and of the training tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragloom.operators import training as G
from ragloom.plans import agents, kg_queries, retrieval_queries
from ragloom.tables import table


def searching_model(rows: DataFrame) -> DataFrame:
    """A deterministic stand-in for a reasoning model: it searches for the question's start, then answers with the first word of the first passage."""
    asks = F.concat(F.lit(f"I look it up. {agents.QUERY} "), F.substring("prompt", 1, 60), F.lit(f" {agents.QUERY_END}"))
    tells = F.concat(F.lit(f" I know. {agents.ANSWER}"), F.regexp_extract("prompt", r"\(1\)\s*(\S+)", 1), F.lit(agents.ANSWER_END))
    return rows.withColumn("answer", F.when(F.contains("prompt", F.lit(agents.DOCS)), tells).otherwise(asks))


def asking_model(rows: DataFrame) -> DataFrame:
    """A deterministic stand-in for a self-asking model: one follow-up by the passage's first word, then the final answer."""
    word = F.regexp_extract("prompt", r"Context1: (\S+)", 1)
    asked = F.contains("prompt", F.lit(agents.FOLLOW_UP))
    return rows.withColumn("answer", F.when(asked, F.concat(F.lit(agents.FINAL), word, F.lit("\n"))).otherwise(F.concat(F.lit(agents.FOLLOW_UP), word, F.lit("\n"))))


def agent_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agents.reasoning(retrieval_queries._docs(spark, sf_dir), retrieval_queries._asked(spark, sf_dir), searching_model, rounds=2, k=2)


def agent_self_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = agents.self_ask(retrieval_queries._docs(spark, sf_dir), retrieval_queries._asked(spark, sf_dir), asking_model, rounds=2, k=2)
    return out.select("qid", F.sha2("pred", 256).alias("pred_sha256"), "n_rounds")


def hard_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name wasn't predicted; those without a golden answer count for nothing."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").withColumn("pred", F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.col("p_type")))
    return G.hard_examples(rows.withColumn("golden_answers", F.array(F.when(k % 7 == 0, " ").otherwise(F.col("p_name"))))).select("p_partkey", "pred")


def trained_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that train a classifier of good and bad, with what another label becomes under the strict rule."""
    rows = table(spark, sf_dir, "lineitem").withColumn("label", F.col("l_linenumber") % 3 - 1)
    strict = G.strict_label(F.col("l_partkey") % 3 - 1).cast("long").alias("strict")
    return G.binary_steps(rows).select("l_orderkey", "l_linenumber", F.col("label").cast("long").alias("label"), strict)


def label_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps, labelled by their own number before and by their user's after."""
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 3 - 1).alias("label"), (F.col("user_id") % 3 - 1).alias("new"), (F.col("event_type") == "error").alias("right"), (F.col("event_id") % 4).alias("n_cited"))
    out = G.label_changes(rows.drop("new"), rows.select("event_id", F.col("new").alias("label")), ["event_id"])
    return out.select(F.col("old_label").cast("long").alias("old_label"), F.col("new_label").cast("long").alias("new_label"), "n", "n_right", "n_uncited")


def step_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value for two of three turns, written back beside the turns of their conversation."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", place.alias("step"))
    traces = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("steps"))
    values = rows.where("step % 3 <> 1").select("conv_id", "step", ((F.col("conv_id") + F.col("step")) % 10).alias("value"))
    out = G.written_back(traces, values, "conv_id", "steps", "scores")
    return out.select("conv_id", F.array_join(F.transform("scores", lambda x: x.cast("string")), ",", "-").alias("scores"))


def alpha_of_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.alpha_of_answers(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_discount")
    return out.select("l_orderkey", "n", F.round("alpha_mean", 9).alias("alpha_mean"), F.round("alpha_std", 6).alias("alpha_std"))


def update_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.update_summary(table(spark, sf_dir, "events"), "event_type", "value")
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")], "n_updates")


def exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest vectors of each label's first one."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    items = rows.groupBy("label").agg(F.min_by("v", "vec_id").alias("v")).select(F.col("label").alias("qid"), "v")
    found = G.exemplars(items, rows.select(F.col("vec_id").alias("doc_id"), "v", F.concat(F.lit("v"), "vec_id").alias("text")), 3)
    return found.select("qid", F.array_join("exemplars", ",").alias("exemplars"))


def severed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's graph without what resembles the tail of its first edge."""
    graph = kg_queries.kg_one_hop(spark, sf_dir)
    answers = graph.where("pos = 1").select("qid", F.upper("t").alias("answer"))
    return G.severed_answers(graph.select("qid", "h", "r", "t"), answers)


def classifier_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.round(F.sum("l_discount") * 10, 6).alias("logit"))
    out = G.route_of(scores, "l_orderkey", "l_returnflag")
    return out.select("l_orderkey", "l_returnflag", F.round("share", 9).alias("share"))


def unit_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts in pieces of three letters; the information of each word, its space included."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("text"))
    words = rows.select("key", F.posexplode(F.split("text", " ")).alias("u", "w"))
    units = words.select("key", "u", F.when(F.col("u") == 0, F.col("w")).otherwise(F.concat(F.lit(" "), "w")).alias("unit"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 3).cast("int")), lambda i: F.substring(F.col("text"), i * 3 + 1, F.lit(3)))
    tokens = rows.where("text <> ''").select("key", F.posexplode(pieces).alias("i", "token")).withColumn("value", ((F.col("key") + F.col("i")) % 10).cast("double"))
    return G.unit_information(tokens, units).select("key", F.col("u").cast("long").alias("u"), F.round("value", 9).alias("value"))


QUERIES = {
    f.__name__: f
    for f in (
        agent_reasoning, agent_self_ask, hard_examples, trained_steps, label_changes, step_values, alpha_of_answers, update_summary, exemplars, severed_answers, classifier_route, unit_information,
    )
}

ORACLE_SQL = {
    "hard_examples": "select p_partkey, case when p_partkey % 3 = 1 then p_type end as pred from part where p_partkey % 3 <> 0 and p_partkey % 7 <> 0",
    "trained_steps": """
select l_orderkey, l_linenumber, (l_linenumber % 3 - 1)::bigint as label, case when l_partkey % 3 = 1 then -1 else l_partkey % 3 - 1 end::bigint as strict from lineitem where l_linenumber % 3 <> 1""",
    "label_changes": """
select (event_id % 3 - 1)::bigint as old_label, (user_id % 3 - 1)::bigint as new_label, count(*) as n, count(*) filter (event_type = 'error') as n_right, count(*) filter (event_id % 4 = 0) as n_uncited
from events group by 1, 2""",
    "step_values": """
with s as (select conv_id, row_number() over (partition by conv_id order by turn) - 1 as step from conversations)
select conv_id, string_agg(case when step % 3 <> 1 then ((conv_id + step) % 10)::varchar else '-' end, ',' order by step) as scores from s group by conv_id""",
    "alpha_of_answers": "select l_orderkey, count(l_discount) as n, round(avg(l_discount), 9) as alpha_mean, round(stddev_pop(l_discount), 6) as alpha_std from lineitem group by l_orderkey",
    "update_summary": """
select event_type, round(avg(value), 6) as mean, round(coalesce(stddev_samp(value), 0), 6) as std, round(min(value), 6) as min, round(max(value), 6) as max, count(value) as n_updates from events group by event_type""",
    "exemplars": f"{retrieval_queries._DENSE} select qid, string_agg('v' || doc_id, ',' order by rank) as exemplars from hits where rank <= 3 group by qid",
    "classifier_route": """
with s as (select l_orderkey, l_returnflag, round(sum(l_discount) * 10, 6) as logit from lineitem group by 1, 2),
w as (select *, exp(logit) / sum(exp(logit)) over (partition by l_orderkey) as share, row_number() over (partition by l_orderkey order by logit desc, l_returnflag) as nth from s)
select l_orderkey, l_returnflag, round(share, 9) as share from w where nth = 1""",
    "unit_information": """
with w as (select p_partkey as key, unnest(range(len(string_split(p_name, ' ')))) as u, unnest(string_split(p_name, ' ')) as w from part),
e as (select key, u, sum(length(w) + (u > 0)::int) over (partition by key order by u) as stop, length(w) + (u > 0)::int as size from w),
t as (select p_partkey as key, i, p_name[3 * i + 1:3 * i + 3] as token, ((p_partkey + i) % 10)::double as value from (select *, unnest(range((length(p_name) + 2) // 3)) as i from part)),
done as (select t.key, t.i, t.value, e.u, count(*) over (partition by t.key, t.i) as n from t join e on e.key = t.key and e.stop > 3 * t.i and e.stop <= 3 * t.i + length(t.token)),
inside as (select t.key, t.i, t.value, e.u, 1 as n from t join e on e.key = t.key and e.stop - e.size <= 3 * t.i and e.stop > 3 * t.i + length(t.token) where t.token <> ' '),
m as (select key, u, avg(value / n) as value from (select * from done union all select * from inside) group by key, u)
select e.key, e.u, round(m.value, 9) as value from e left join m using (key, u)""",
}
