"""Reward, statistics and curation queries.

Trajectories are the users of ``events`` in order of time; traces are documents with their labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragloom.operators import curate as C
from ragloom.operators import kg_tables as T
from ragloom.operators import reward as R
from ragloom.operators import stats as S
from ragloom.plans import kg_queries
from ragloom.tables import table


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type", F.row_number().over(order).cast("long").alias("step"))
    return rows.select(F.col("user_id").alias("key"), "step", (F.col("value") / 97.0).alias("reward"), (F.col("event_id") % 7 / 7.0).alias("value"), "event_type", "event_id")


def alpha_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _steps(spark, sf_dir)
    gate = R.alpha(F.col("value"), F.col("event_id") % 10 / 10.0, F.col("event_id") % 4 / 4.0)
    total = R.step_total(gate, F.col("value"), R.text_reward(F.abs("reward")), 0.5, 2.0)
    return rows.select("event_id", F.round(gate, 9).alias("alpha"), F.round(total, 9).alias("total"))


def alpha_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _steps(spark, sf_dir).withColumn("alpha", R.alpha(F.col("value"), F.col("event_id") % 10 / 10.0, F.lit(1.0)))
    out = S.summary(rows, "alpha", ["event_type"])
    return out.select("event_type", "n", *[F.round(c, 9).alias(c) for c in ("mean", "std", "p10", "median", "p90")])


def discounted_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.discounted_returns(_steps(spark, sf_dir), 0.95).select("key", "step", F.round("ret", 6).alias("ret"))


def gae(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.gae(_steps(spark, sf_dir), 0.99, 0.95).select("key", "step", F.round("advantage", 6).alias("advantage"))


def whitened_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.whitened(_steps(spark, sf_dir), "reward", F.col("event_type") != "error").select("event_id", F.round("whitened", 6).alias("whitened"))


def group_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.group_advantage(_steps(spark, sf_dir), "key", "reward").select("key", "step", F.round("advantage", 6).alias("advantage"))


def outcome_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer is a trajectory of orders; those in debt are invalid, the large ones are right."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    outcomes = customer.select(F.col("c_custkey").alias("key"), (F.col("c_acctbal") >= 0).alias("valid"), (F.col("c_acctbal") > 5000).cast("double").alias("em"))
    steps = orders.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("step"), (F.col("o_totalprice") / 1000.0).alias("reward"))
    return R.outcome_adjusted(steps, outcomes).select("key", F.col("step").cast("long").alias("step"), F.round("reward", 6).alias("reward"))


def step_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label policy over the counts of each order line."""
    rows = table(spark, sf_dir, "lineitem")
    cited, verified = F.col("l_linenumber") % 4, F.least(F.col("l_linenumber") % 4, F.col("l_partkey") % 4)
    label = R.step_label(cited, verified, F.least(cited, F.col("l_suppkey") % 4), F.col("l_orderkey") % 7, F.col("l_returnflag") == "R", F.col("l_linestatus") == "O")
    return rows.select("l_orderkey", "l_linenumber", F.round(label, 9).alias("label"))


def trajectory_ihr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of negative steps in each order, and the mean over orders with steps."""
    labels = step_labels(spark, sf_dir).groupBy("l_orderkey").agg(F.avg((F.col("label") < 0).cast("double")).alias("ihr"))
    return labels.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ihr"), 9).alias("mean_ihr"))


def contradiction_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an assistant's turn contradicts an earlier text of its conversation; every fourth text is negated first."""
    said = F.when(F.col("turn") % 4 == 1, F.concat(F.lit("not "), F.col("text"))).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "conversations").withColumn("said", F.regexp_replace(said, r"[^\x00-\x7F]", "x"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("prior", F.collect_list("said").over(before)).where("role = 'assistant'")
    return rows.select("conv_id", "turn", R.is_contradiction(F.col("said"), F.col("prior")).alias("contradicts"))


def span_logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as tokens, spans from every third line to the next one's start; mean price of the lines in each span."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("i"), (-F.col("l_discount")).alias("logprob"))
    heads = rows.where("i % 3 = 1").select("key", F.col("i").alias("step"), F.col("i").alias("start"))
    found = R.span_means(rows, R.spans(heads, "key", "start", F.lit(100)))
    return found.select("key", "step", F.round("mean_logprob", 9).alias("mean_logprob"), "n_tokens")


def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.kappa(table(spark, sf_dir, "labels"), F.col("quality"), F.col("toxic"))
    return out.select("n", F.round("po", 9).alias("po"), F.round("kappa", 9).alias("kappa"))


def paired_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.paired_t(table(spark, sf_dir, "labels"), F.col("quality"), F.col("toxic"))
    return out.select("n", *[F.round(c, 9).alias(c) for c in ("mean_diff", "std_diff", "t")])


def welch_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    out = S.welch_t(rows, F.col("quality") == 1, F.col("n_chars"))
    return out.select("n1", "n2", *[F.round(c, 6).alias(c) for c in ("mean1", "mean2", "t", "df")])


def t_test_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p-values of both t tests; they need the t distribution, which SQL lacks."""
    labels = table(spark, sf_dir, "labels")
    rows = labels.join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    a = S.paired_t(labels, F.col("quality"), F.col("toxic")).select(F.lit("paired").alias("test"), "t", "p")
    return a.unionByName(S.welch_t(rows, F.col("quality") == 1, F.col("n_chars")).select(F.lit("welch").alias("test"), "t", "p"))


def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.paired_bootstrap(table(spark, sf_dir, "labels"), "doc_id", "quality", "toxic")


def seed_mean_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of the order price by status and priority; the interval is tested apart."""
    out = S.mean_ci(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice")
    return out.select("o_orderstatus", "o_orderpriority", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


def seed_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.mean_ci(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice")


def calibration_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    chance = F.when(F.col("doc_id") % 11 == 0, 0.0).otherwise((F.col("doc_id") % 11) / 11.0)
    return S.calibration_loss(table(spark, sf_dir, "labels"), F.col("quality"), chance).select(F.round("loss", 6).alias("loss"))


def subject_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by subject and over all."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum((F.col("l_quantity") > 25).cast("long")).alias("right"), F.count(F.lit(1)).alias("n"))
    out = rows.rollup("l_returnflag", "l_linestatus").agg(F.sum("right").alias("right"), F.sum("n").alias("n"))
    return out.select(F.coalesce("l_returnflag", F.lit("all")).alias("subject"), F.coalesce("l_linestatus", F.lit("all")).alias("part"), "n", F.round(F.col("right") / F.col("n"), 9).alias("accuracy"))


def variance_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 24-row trend of each user's values and whether the last four have collapsed."""
    rows = _steps(spark, sf_dir).withColumn("size", F.abs("reward"))
    order = Window.partitionBy("key").orderBy("step")
    trend = F.avg("size").over(order.rowsBetween(-23, 0))
    before, last = F.max("size").over(order.rowsBetween(Window.unboundedPreceding, -4)), F.max("size").over(order.rowsBetween(-3, 0))
    return rows.select("key", "step", F.round(trend, 9).alias("trend"), F.coalesce((before > 0.05) & (last <= 1e-6), F.lit(False)).alias("collapsed"))


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n = (F.col("n_chars") % 9).cast("int")
    return docs.select(
        "doc_id", "source", n.alias("steps"), (F.col("n_chars") % 101 / 100.0).alias("coverage"), (F.col("n_chars") % 89 / 88.0).alias("f1"), (F.col("n_chars") % 13 / 12.0).alias("triple_rate"), "quality"
    )


def silver_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _traces(spark, sf_dir).where(C.silver_ok(F.col("steps"), F.col("coverage"), F.col("f1"), F.col("triple_rate"))).select("doc_id", "source")


def silver_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _traces(spark, sf_dir).withColumn("bucket", F.when(C.quality_ok(F.col("steps"), F.col("f1")), C.bucket_of(F.col("triple_rate"))))
    return C.stratified_quota(rows.select("doc_id", "source", "bucket"), "source", "doc_id").select("doc_id", "source", "bucket", "accepted")


def bucket_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by bucket, accepted and all."""
    return silver_quota(spark, sf_dir).groupBy(F.coalesce("bucket", F.lit("rejected_quality")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if("accepted").alias("n_accepted"))


def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order: the work that is left."""
    work = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return C.resume(work, table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def cache_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return C.overlap_counts(a, table(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).alias("k")), "k")


def hard_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return C.hard_mix(rows.where("quality = 0").select("doc_id"), rows.where("quality = 1").select("doc_id"), "doc_id")


def seeded_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents of every source in hash order."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    return C.hash_sample(rows, "doc_id", F.lit(10), 7, "source")


def route_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing by price, each branch with its own column work, and the merge."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", C.route(F.col("o_totalprice"), 50_000.0, 200_000.0).alias("route"))
    out = C.split_and_merge(rows, F.col("route") == "A", lambda d: d.withColumn("rounds", F.lit(0)), lambda d: d.withColumn("rounds", F.when(F.col("route") == "B", 1).otherwise(3)))
    return out.select("o_orderkey", "route", "rounds")


def sever_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that touch the region ASIA severed."""
    edges = kg_queries.edges(spark, sf_dir).withColumn("key", F.concat_ws("|", "h", "r", "t"))
    hit = (F.lower("h") == "asia") | (F.lower("t") == "asia")
    return C.severed(edges, hit, "key", T.NOISE_ENTITIES, T.NOISE_RELATIONS).select("key", "h", "r", "t", "severed")


QUERIES = {
    f.__name__: f
    for f in (
        alpha_gate, alpha_summary, discounted_returns, gae, whitened_rewards, group_advantage, outcome_reward, step_labels, trajectory_ihr, contradiction_flags, span_logprobs, kappa, paired_t,
        welch_t, t_test_p_values, paired_bootstrap, seed_mean_ci, seed_intervals, calibration_loss, subject_rollup, variance_log, silver_filter, silver_quota, bucket_distribution, resume_anti,
        cache_missing, hard_mix, seeded_subset, route_merge, sever_path,
    )
}

_STEPS = """steps as (select user_id as key, row_number() over (partition by user_id order by ts, event_id) as step, value / 97.0::double as reward, (event_id % 7)::double / 7.0::double as value, event_type, event_id from events)"""
_ALPHA = lambda d, c, e: f"(1 / (1 + exp(-((1.0::double * {d} + 1.5::double * {c} + -0.8::double * {e} + -2.0::double) / 0.5::double))))"
_TRACES = """traces as (select doc_id, source, (n_chars % 9)::int as steps, (n_chars % 101)::double / 100.0::double as coverage, (n_chars % 89)::double / 88.0::double as f1, (n_chars % 13)::double / 12.0::double as triple_rate from documents)"""
_QUOTA = f"""recursive {_TRACES},
b as (select doc_id, source, case when steps between 3 and 7 and f1 >= 0.3::double then case when triple_rate >= 0.5::double then 'kg_rich' when triple_rate >= 0.15::double then 'kg_medium' else 'kg_sparse' end end as bucket,
  row_number() over (partition by source order by doc_id) as n from traces),
fold as (
  select source, 0::bigint as n, 0 as rich, 0 as medium, 0 as sparse, null::bigint as doc_id, null::varchar as bucket, false as accepted from (select distinct source from b)
  union all
  select source, n, rich + (accepted and bucket = 'kg_rich')::int, medium + (accepted and bucket = 'kg_medium')::int, sparse + (accepted and bucket = 'kg_sparse')::int, doc_id, bucket, accepted from (
    select f.source, b.n, f.rich, f.medium, f.sparse, b.doc_id, b.bucket,
      coalesce(b.bucket is not null and (f.rich + f.medium + f.sparse = 0 or not ((b.bucket = 'kg_sparse' and f.sparse >= 0.25::double * (f.rich + f.medium + f.sparse + 1))
        or (b.bucket = 'kg_medium' and f.medium >= 0.35::double * (f.rich + f.medium + f.sparse + 1)))), false) as accepted
    from fold f join b on b.source is not distinct from f.source and b.n = f.n + 1))"""
_LABEL = """case when l_linenumber % 4 = 0 then case when l_linestatus = 'O' then 0.0 when l_returnflag = 'R' then -1.0 else 0.0 end
  when l_orderkey % 7 < 3 then 0.0 when l_returnflag = 'R' then -1.0
  else (least(l_linenumber % 4, l_partkey % 4)::double / (l_linenumber % 4)) * (least(l_linenumber % 4, l_suppkey % 4)::double / (l_linenumber % 4)) end::double"""
ORACLE_SQL = {
    "alpha_gate": f"""with {_STEPS}, a as (select *, {_ALPHA('value', '((event_id % 10)::double / 10)', '((event_id % 4)::double / 4)')} as al, tanh((2.5::double - abs(reward)) / 1.5::double) as tx from steps)
select event_id, round(al, 9) as alpha, round((al * value + (1 - al) * tx * 0.5::double) * 2.0::double, 9) as total from a""",
    "alpha_summary": f"""with {_STEPS}, a as (select event_type, {_ALPHA('value', '((event_id % 10)::double / 10)', '1.0::double')} as x from steps)
select event_type, count(x) as n, round(avg(x), 9) as mean, round(coalesce(stddev_samp(x), 0), 9) as std, round(quantile_cont(x, 0.1), 9) as p10, round(quantile_cont(x, 0.5), 9) as median, round(quantile_cont(x, 0.9), 9) as p90 from a group by event_type""",
    "discounted_returns": f"with {_STEPS} select a.key, a.step, round(sum(b.reward * pow(0.95::double, b.step - a.step)), 6) as ret from steps a join steps b on a.key = b.key and b.step >= a.step group by 1, 2",
    "gae": f"""with {_STEPS}, d as (select key, step, reward + 0.99::double * coalesce(lead(value) over (partition by key order by step), 0.0) - value as delta from steps)
select a.key, a.step, round(sum(b.delta * pow(0.99::double * 0.95::double, b.step - a.step)), 6) as advantage from d a join d b on a.key = b.key and b.step >= a.step group by 1, 2""",
    "whitened_rewards": f"""with {_STEPS}, w as (select avg(reward) as m, var_samp(reward) as v from steps where event_type <> 'error')
select event_id, round((reward - m) / sqrt(v + 1e-8::double), 6) as whitened from steps, w""",
    "group_advantage": f"""with {_STEPS}
select key, step, round((reward - avg(reward) over (partition by key)) / (coalesce(stddev_samp(reward) over (partition by key), 0) + 1e-6::double), 6) as advantage from steps""",
    "outcome_reward": """
with s as (select c_custkey as key, o_orderkey as step, o_totalprice / 1000.0::double as reward, c_acctbal >= 0 as valid, (c_acctbal > 5000)::int::double as em,
  row_number() over (partition by c_custkey order by o_orderkey desc nulls first) as back from customer left join orders on o_custkey = c_custkey)
select key, coalesce(step, 0) as step, round(coalesce(reward, 0.0) + case when back <> 1 then 0.0 when valid then 10.0 * em else -10.0 end::double, 6) as reward from s where step is not null or not valid""",
    "step_labels": f"select l_orderkey, l_linenumber, round({_LABEL}, 9) as label from lineitem",
    "trajectory_ihr": f"select count(*) as n, round(avg(ihr), 9) as mean_ihr from (select l_orderkey, avg(({_LABEL} < 0)::int::double) as ihr from lineitem group by l_orderkey)",
    "contradiction_flags": r"""
with r as (select *, regexp_replace(case when turn % 4 = 1 then 'not ' || text else text end, '[^\x00-\x7F]', 'x', 'g') as said from conversations),
w as (select *, list_distinct(regexp_extract_all(lower(said), '\b\w{4,}\b')) as ws, regexp_matches(lower(said), '\b(not|never|no|cannot)\b') as neg from r),
p as (select a.conv_id, a.turn, bool_or(len(list_intersect(a.ws, b.ws)) >= 2 and a.neg <> b.neg) as c from w a join w b on a.conv_id = b.conv_id and b.turn < a.turn group by 1, 2)
select w.conv_id, w.turn, coalesce(p.c and w.said <> '' and not regexp_matches(w.said, '(?i)\b(unknown|insufficient|lacks?|lacking)\b'), false) as contradicts from w left join p using (conv_id, turn) where role = 'assistant'""",
    "span_logprobs": """
with h as (select l_orderkey as key, l_linenumber as start, coalesce(lead(l_linenumber) over (partition by l_orderkey order by l_linenumber), 100) as stop from lineitem where l_linenumber % 3 = 1)
select key, start as step, round(avg(-l_discount), 9) as mean_logprob, count(l_discount) as n_tokens from h left join lineitem on l_orderkey = key and l_linenumber >= start and l_linenumber < stop group by key, start""",
    "kappa": """
with s as (select count(*) as n, avg((quality = toxic)::int::double) as po, avg(quality::double) as pa, avg(toxic::double) as pb from labels)
select n, round(po, 9) as po, round(case when abs(1 - (pa * pb + (1 - pa) * (1 - pb))) < 1e-12 then 1.0 else (po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) end, 9) as kappa from s""",
    "paired_t": """
with s as (select count(*) as n, avg(quality - toxic) as m, stddev_samp(quality - toxic) as sd from labels)
select n, round(m, 9) as mean_diff, round(sd, 9) as std_diff, round(m / (sd / sqrt(n)), 9) as t from s""",
    "welch_t": """
with s as (select count(*) filter (quality = 1) as n1, count(*) filter (quality <> 1) as n2, avg(n_chars) filter (quality = 1) as m1, avg(n_chars) filter (quality <> 1) as m2,
  var_samp(n_chars) filter (quality = 1) as v1, var_samp(n_chars) filter (quality <> 1) as v2 from labels join documents using (doc_id))
select n1, n2, round(m1, 6) as mean1, round(m2, 6) as mean2, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) as t,
  round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 6) as df from s""",
    "seed_mean_ci": "select o_orderstatus, o_orderpriority, count(o_totalprice) as n, round(avg(o_totalprice), 4) as mean, round(coalesce(stddev_samp(o_totalprice), 0), 4) as std from orders group by 1, 2",
    "calibration_loss": """
with c as (select quality as y, (doc_id % 11)::double / 11 as p from labels)
select round(-avg(y * (case when p <= 0 then -100.0 else ln(p) end) + (1 - y) * ln(1 - p)) * 0.1, 6) as loss from c""",
    "subject_rollup": """
select coalesce(l_returnflag, 'all') as subject, coalesce(l_linestatus, 'all') as part, count(*) as n, round(sum((l_quantity > 25)::int)::double / count(*), 9) as accuracy from lineitem group by rollup (l_returnflag, l_linestatus)""",
    "variance_log": f"""with {_STEPS}, s as (select key, step, abs(reward) as size from steps)
select key, step, round(avg(size) over (partition by key order by step rows between 23 preceding and current row), 9) as trend,
  coalesce(max(size) over (partition by key order by step rows between unbounded preceding and 4 preceding) > 0.05 and max(size) over (partition by key order by step rows between 3 preceding and current row) <= 1e-6::double, false) as collapsed from s""",
    "silver_filter": f"with {_TRACES} select doc_id, source from traces where steps between 3 and 7 and coverage >= 0.5::double and f1 >= 0.5::double and triple_rate >= 0.4::double",
    "silver_quota": f"with {_QUOTA} select doc_id, source, bucket, accepted from fold where n > 0",
    "bucket_distribution": f"with {_QUOTA} select coalesce(bucket, 'rejected_quality') as bucket, count(*) as n, count(*) filter (accepted) as n_accepted from fold where n > 0 group by 1",
    "resume_anti": "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')",
    "cache_missing": """
with a as (select distinct c_custkey as k from customer), b as (select distinct o_custkey * 2 as k from orders)
select (select count(*) from a where k in (select k from b)) as both, (select count(*) from a where k not in (select k from b)) as only_a, (select count(*) from b where k not in (select k from a)) as only_b""",
    "hard_mix": """
with e as (select doc_id, row_number() over (order by sha256(doc_id || ':42'), doc_id) as n from labels where quality = 1),
h as (select doc_id from labels where quality = 0)
select doc_id, true as hard from h union all select doc_id, false from e where n <= (select floor(count(*) / 0.7::double * (1 - 0.7::double))::bigint from h)""",
    "seeded_subset": "select doc_id, source from (select doc_id, source, row_number() over (partition by source order by sha256(doc_id || ':7'), doc_id) as n from documents) where n <= 10",
    "route_merge": """
select o_orderkey, case when o_totalprice < 50000 then 'A' when o_totalprice < 200000 then 'B' else 'C' end as route, case when o_totalprice < 50000 then 0 when o_totalprice < 200000 then 1 else 3 end as rounds from orders""",
}
