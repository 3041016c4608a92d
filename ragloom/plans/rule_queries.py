"""Queries of smaller rules of evaluation, monitoring and curation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions import metrics as M
from ragloom.operators import compress, curate, traces
from ragloom.operators import retrieval as R
from ragloom.operators import stats as S
from ragloom.operators import training as G
from ragloom.operators.ranks import batched
from ragloom.plans import agent_queries, evaluation, kg_queries, retrieval_queries
from ragloom.plans.text_queries import _toolkit
from ragloom.session import scratch_path
from ragloom.sources import readers
from ragloom.tables import table


def pattern_em(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types against patterns: of the type's first word and anything, of digits, and of any plated metal."""
    golds = F.array(F.lit("[0-9]+"), F.concat(F.lit("econ.* "), F.substring_index("p_type", " ", -1)), F.lit("(small|large) PLATED [a-z]+"))
    return table(spark, sf_dir, "part").select("p_partkey", M.em_pattern(F.concat(F.lit("The "), "p_type", F.lit("!")), golds).alias("em"))


def choice_golds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two data sets of the same questions: one has choices everywhere, in the other some rows have none."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.array("s_name", F.lit("none")).alias("all"), F.array((F.col("s_suppkey") % 2).cast("int")).alias("indexes"), F.array(F.col("s_suppkey").cast("string")).alias("golden_answers"))
    whole = M.data_set_golds(rows.withColumn("choices", F.col("all"))).withColumn("set", F.lit("whole"))
    some = F.when(F.col("s_suppkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.col("all"))
    mixed = M.data_set_golds(rows.withColumn("choices", some)).withColumn("set", F.lit("mixed"))
    return whole.unionByName(mixed).select("set", "s_suppkey", F.array_join("golds", "|").alias("golds"))


def resume_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred orders by price that have no line yet returned."""
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return curate.resume(table(spark, sf_dir, "orders"), done, "o_orderkey", 100, ["o_totalprice", "o_orderkey"]).select("o_orderkey", "o_totalprice")


def severed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each question's graph was severed; the graphs of a third of the questions are taken for missing."""
    graph = agent_queries.severed_answers(spark, sf_dir).where(F.length("qid") % 3 != 0)
    return G.severed_items(kg_queries.questions(spark, sf_dir), graph, 5)


def context_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each conversation against its first one."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("i"), "text")
    first = rows.groupBy("key").agg(F.min_by("text", "i").alias("text"))
    return compress.bm25_order(rows, first).select("key", "i", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def kl_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kl = F.when(F.col("event_id") % 13 == 0, float("nan")).when(F.col("event_id") % 11 == 0, -F.col("value")).otherwise(F.col("value"))
    rows = table(spark, sf_dir, "events").select(S.kl_verdict(kl).alias("verdict"))
    return rows.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def reward_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a run; that of every third user ends without a reward."""
    rows = table(spark, sf_dir, "events").withColumn("x", F.when((F.col("user_id") % 3 == 0) & (F.col("event_id") % 1000 >= 500), 0.0).otherwise(F.col("value")))
    return S.reward_collapse(rows, "user_id", "event_id", "x").select("user_id", "n", "collapsed")


def neighbour_judgement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each label's first one judge it: a vector is better, worse or neither by its id."""
    better = F.when(F.col("vec_id") % 7 < 3, True).when(F.col("vec_id") % 7 < 5, False)
    judged = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), better.alias("better"))
    return R.neighbour_judgement(retrieval_queries.dense_topk(spark, sf_dir), judged, 10)


def token_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each part's name, type and brand as segments with rates, cut into tokens of three characters, in windows of five tokens."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    each = rows.select("key", F.posexplode(F.split("text", " ")).alias("s", "word"), F.size(F.split("text", " ")).alias("n"))
    size = F.length("word") + F.when(F.col("s") < F.col("n") - 1, 1).otherwise(0)
    rate = F.when((F.col("key") + F.col("s")) % 4 == 0, 1.0).otherwise(F.col("s") % 3 / 4.0 + 0.25)
    segments = each.select("key", "s", size.alias("n_chars"), rate.alias("rate"), ((F.col("key") + F.col("s")) % 4 != 0).alias("compress"))
    place = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 3).cast("int"))
    tokens = rows.select("key", F.length("text").alias("whole"), F.explode(place).alias("i")).select("key", "i", F.least(F.lit(3), F.col("whole") - 3 * F.col("i")).alias("n_chars"))
    return compress.token_rates(tokens, segments, 5)


def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names answered by their name with a lead-in, or by their type; one metric is plugged in, one is unknown and one needs a column that isn't there. Read back from the written report."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.when(k % 2 == 0, F.concat(F.lit("So: the "), "p_name", F.lit("."))).otherwise(F.col("p_type")).alias("pred"), F.array("p_name").alias("golden_answers"))
    path = scratch_path(spark, "report")
    extra = {"n_chars": lambda p, g: F.length(p), "broken": lambda p, g: F.col("no_such_column")}
    report = evaluation.run(rows, ["em", "acc", "n_chars", "nothing", "broken"], process=lambda r: r.withColumn("pred", F.regexp_replace("pred", "^So: ", "")), path=path, extra=extra)
    written = readers.key_values(spark, f"{path}/metric_score").select("name", F.round("number", 9).alias("score"), F.lit(False).alias("failed"))
    return written.unionByName(spark.createDataFrame([(n, None, True) for n in report.failed], "name string, score double, failed boolean"))


def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean discount by line number, as scores by size."""
    out = evaluation.curve(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_discount")
    return out.select(F.col("N").cast("long").alias("N"), *[F.round(c, 9).alias(c) for c in ("mean", "std", "gain")])


def document_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 64 documents, longest first."""
    out = batched(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), 64, [F.col("n_chars").desc(), F.col("doc_id")])
    return out.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("longest"), F.min("n_chars").alias("shortest"))


def capped_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three turns of each conversation as its steps, with a text reward by a backend that is plugged in for this."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("steps"))
    steps = rows.select("conv_id", F.explode(traces.capped(F.col("steps"), 3)).alias("s")).select("conv_id", "s.turn", F.lit("").alias("prompt"), F.coalesce("s.text", F.lit("")).alias("step"))
    evaluation.BACKENDS["by_length"] = evaluation.nll_backend(lambda prompt, step: F.length(step) / 100.0)
    scored = evaluation.text_rewards(evaluation.text_rewards(steps, "by_length"), "dummy", out="nothing")
    return scored.select("conv_id", "turn", F.round("text_reward", 9).alias("text_reward"), "nothing")


QUERIES = {f.__name__: f for f in (pattern_em, choice_golds, resume_capped, severed_items, context_bm25, kl_verdicts, reward_collapse, neighbour_judgement, token_rates, evaluation_report, learning_curve, document_batches, capped_steps)}

ORACLE_SQL = {
    "evaluation_report": f"""
with p as (select case when p_partkey % 2 = 0 then 'the ' || p_name || '.' else p_type end as pred, p_name from part),
s as (select avg((trim(regexp_replace(lower(replace(pred, '.', '')), '^the ', '')) = lower(p_name))::int::double) as em,
  avg(contains({_toolkit("pred")}, {_toolkit("p_name")})::int::double) as acc, avg(length(pred)) as n_chars from p)
select 'em' as name, round(em, 9) as score, false as failed from s union all select 'acc', round(acc, 9), false from s union all select 'n_chars', round(n_chars, 9), false from s
union all select 'nothing', null, true union all select 'broken', null, true""",
    "learning_curve": """
with p as (select l_linenumber as n, avg(l_discount) as mean, coalesce(stddev_samp(l_discount), 0) as std from lineitem group by 1)
select n::bigint as "N", round(mean, 9) as mean, round(std, 9) as std, round(mean - lag(mean) over (order by n), 9) as gain from p""",
    "document_batches": """
with r as (select n_chars, (row_number() over (order by n_chars desc, doc_id) - 1) // 64 as batch from documents)
select batch, count(*) as n, max(n_chars) as longest, min(n_chars) as shortest from r group by 1""",
    "capped_steps": """
with r as (select conv_id, turn, coalesce(text, '') as step, row_number() over (partition by conv_id order by turn) as nth from conversations)
select conv_id, turn, round(tanh((2.5 - length(step) / 100.0::double) / 1.5::double), 9) as text_reward, 0.0::double as nothing from r where nth <= 3""",
    "token_rates": """
with t as (select p_partkey as key, p_name || ' ' || p_type || ' ' || p_brand as text from part),
w as (select key, unnest(string_split(text, ' ')) as word, unnest(range(len(string_split(text, ' ')))) as s from t),
z as (select key, s, case when (key + s) % 4 = 0 then 1.0::double else s % 3 / 4.0::double + 0.25::double end as rate, (key + s) % 4 <> 0 as compress,
  sum(length(word) + 1) over (partition by key order by s) as stop, length(word) + 1 as size from w),
k as (select key, unnest(range((length(text) + 2) // 3)) as i from t),
m as (select k.key, i, case when count(*) > 1 and not bool_and(compress) then 1.0 else min(rate) end as rate
  from k join t using (key) join z on z.key = k.key and stop - size < least(3 * i + 3, length(text)) and stop > 3 * i group by k.key, i),
l as (select *, i // 5 as win, case when rate <> lag(rate) over (partition by key, i // 5 order by i) then 1 else 0 end as new from m),
r as (select *, sum(new) over (partition by key, win order by i) as run from l)
select key, win as window, run::bigint as run, count(*) as n, any_value(rate)::double as rate from r group by key, win, run""",
    "pattern_em": f"""
with p as (select p_partkey, {_toolkit("'The ' || p_type || '!'")} as pred, p_type from part)
select p_partkey, case when regexp_full_match(pred, '(?i)[0-9]+') or regexp_full_match(pred, '(?i)econ.* ' || string_split(p_type, ' ')[-1]) or regexp_full_match(pred, '(?i)(small|large) PLATED [a-z]+') then 1.0 else 0.0 end::double as em from p""",
    "choice_golds": """
select 'whole' as set, s_suppkey, case s_suppkey % 2 when 0 then s_name else 'none' end as golds from supplier
union all select 'mixed', s_suppkey, case when (select count(*) from supplier where s_suppkey % 5 = 0) > 0 then s_suppkey::varchar when s_suppkey % 2 = 0 then s_name else 'none' end from supplier""",
    "resume_capped": "select o_orderkey, o_totalprice from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R') order by o_totalprice, o_orderkey limit 100",
    "context_bm25": """
with w as (select conv_id as key, turn as i, string_split(coalesce(text, ''), ' ') as w from conversations),
e as (select key, i, len(w) as dl, unnest(w) as word from w),
tf as (select key, i, any_value(dl) as dl, word, count(*) as tf from e group by key, i, word),
z as (select key, count(*) as n, avg(len(w)) as avgdl from w group by key),
d as (select key, word, count(*) as df from tf group by key, word),
f as (select key, word, avgdl, ln(n - df + 0.5::double) - ln(df + 0.5::double) as idf from d join z using (key)),
g as (select key, word, avgdl, case when idf < 0 then 0.25::double * avg(idf) over (partition by key) else idf end as idf from f),
a as (select conv_id as key, arg_min(text, turn) as text from conversations group by 1),
q as (select key, word, count(*) as q from (select key, unnest(string_split(text, ' ')) as word from a) group by 1, 2),
s as (select key, i, sum(q * idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))) as score from tf join q using (key, word) join g using (key, word) group by key, i),
r as (select w.key, w.i, round(coalesce(score, 0.0), 9) as score from w left join s using (key, i))
select key, i, round(score, 6) as score, row_number() over (partition by key order by score desc, i) as rank from r""",
    "kl_verdicts": """
with k as (select case when event_id % 13 = 0 then 'nan'::double when event_id % 11 = 0 then -value else value end as kl from events)
select case when isnan(kl) then 'nan' when kl < 0 or kl > 50 then 'diverging' when kl between 1 and 12 then 'healthy' when kl < 1 then 'very low' when kl is not null then 'high' end as verdict, count(*) as n from k group by 1""",
    "reward_collapse": """
with x as (select user_id, case when user_id % 3 = 0 and event_id % 1000 >= 500 then 0.0 else value end as x, row_number() over (partition by user_id order by event_id desc) as back from events)
select user_id, count(*) as n, coalesce(count(*) >= 8 and max(x) filter (back > 4) > 0.05 and max(x) filter (back <= 4) <= 1e-6, false) as collapsed from x group by 1""",
    "neighbour_judgement": f"""{retrieval_queries._DENSE},
j as (select vec_id as doc_id, case when vec_id % 7 < 3 then 1 when vec_id % 7 < 5 then -1 else 0 end as point from embeddings),
t as (select sum(point) as surplus, trunc(sum(point) * 10 / count(*)::double) as share from j),
o as (select qid, sum(point) as own from hits join j using (doc_id) group by 1)
select qid, case when surplus < 0 then not (own < 0 and own <= share) else own > 0 and own >= share end as retrieve from o, t""",
}
