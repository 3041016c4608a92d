"""Queries of stored state and of statistics over groups: keyed streams, counted writes, tests by group, links with overrides and by context, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.operators import joins, kg
from ragloom.operators import stats as S
from ragloom.plans import more_queries
from ragloom.session import scratch_path
from ragloom.sources import sinks
from ragloom.tables import table


def corpus_write_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a write of the documents as passages counted, and what is in its files."""
    path = scratch_path(spark, "corpus")
    counts = sinks.corpus(table(spark, sf_dir, "documents"), path)
    written = spark.read.schema("id string, contents string").json(path)
    seen = written.agg(F.count(F.lit(1)).alias("in_files"), F.sum(F.length("contents")).alias("n_chars"))
    return seen.select(*[F.lit(counts[n]).cast("long").alias(f"n_{n}") for n in ("read", "written", "skipped", "repaired")], "in_files", "n_chars")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and quarter of users as data sets and metrics: an event's value against another of its user's features; some values are missing."""
    rows = table(spark, sf_dir, "events")
    a = F.when(F.col("event_id") % 17 != 0, F.col("value"))
    return rows.select("event_id", "event_type", (F.col("user_id") % 4).alias("quarter"), a.alias("a"), (F.col("event_id") * 37 % 101 / 2.0).alias("b"))


def significance_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.paired_bootstrap_by(_scores(spark, sf_dir), ["event_type", "quarter"], "event_id", "a", "b", resamples=1000)
    return S.adjusted(out).select("event_type", "quarter", "n", *[F.round(c, 9).alias(c) for c in ("mean_diff", "low", "high", "p", "p_holm", "p_bh")])


def group_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and mean differences of each group, without resamples' share."""
    out = S.paired_bootstrap_by(_scores(spark, sf_dir), ["event_type", "quarter"], "event_id", "a", "b", resamples=1)
    return out.select("event_type", "quarter", "n", F.round("mean_diff", 6).alias("mean_diff"))


def adjusted_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given p values of each supplier's lines, adjusted within a nation's suppliers."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") % 9 != 0, F.col("s_suppkey") * 7919 % 1009 / 20000.0).alias("p"))
    out = S.adjusted(rows, families=["s_nationkey"])
    return out.select("s_suppkey", F.round("p_holm", 9).alias("p_holm"), F.round("p_bh", 9).alias("p_bh"))


def link_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names linked with known links for some, by an expected type or by default; a few names have no candidate."""
    decisions = more_queries.link_decisions(spark, sf_dir)
    part = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("mention")).agg(F.min("p_partkey").alias("k"))
    mentions = part.select("mention", F.when(F.col("k") % 3 == 0, F.array(F.lit("film"), F.lit("steel"))).alias("expected_types")).unionByName(spark.createDataFrame([("no such part", ["film"])], "mention string, expected_types array<string>"))
    clean = F.lower(F.trim(F.regexp_replace("mention", r"\s+", " ")))
    one = part.where("k % 5 = 0").select(clean.alias("mention"), F.lit("steel").alias("kind"), F.concat(F.lit("S"), "k").alias("entity_id"))
    two = part.where("k % 10 = 0").select(clean.alias("mention"), F.lit("default").alias("kind"), F.concat(F.lit("D"), "k").alias("entity_id"))
    out = kg.overridden(decisions, mentions, one.unionByName(two))
    return out.select("mention", "entity_id", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"), "abstained")


def context_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's id with two others as a step's entities, set against its label's first vector; a fifth of the vectors are unknown, a third of those without a confidence too."""
    rows = table(spark, sf_dir, "embeddings")
    n = rows.count()
    i = F.col("vec_id")
    steps = rows.select(i.alias("key"), F.when(i % 7 != 0, F.array(i, (i * 3 + 1) % n, (i * 5 + 2) % n)).otherwise(F.array().cast("array<bigint>")).alias("entities"))
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v"))
    contexts = rows.where("vec_id % 11 <> 0").join(first, "label").select(i.alias("key"), "v")
    vectors = rows.where("vec_id % 5 <> 0").select(i.alias("entity"), F.col("embedding").alias("v"))
    exact = rows.where("vec_id % 3 <> 0").select(i.alias("entity"), (i % 10 / 10.0).alias("confidence"))
    return joins.context_confidence(steps, vectors, contexts, exact).select("key", F.round("confidence", 6).alias("confidence"))


QUERIES = {f.__name__: f for f in (corpus_write_counts, significance_by_group, group_differences, adjusted_p, link_overrides, context_confidence)}

ORACLE_SQL = {
    "corpus_write_counts": """
with t as (select doc_id, text, string_split(text, chr(10))[1] as line, text[strpos(text || chr(10), chr(10)) + 1:] as body from documents),
u as (select *, regexp_replace(line, '^"+|"+$', '', 'g') as title, doc_id is not null and text is not null as usable from t),
c as (select usable, usable and (title <> line or title = '') as repaired, case when title = '' then body else title || chr(10) || body end as contents from u)
select count(*) as n_read, count(*) filter (usable) as n_written, count(*) filter (not usable) as n_skipped, count(*) filter (repaired) as n_repaired,
  count(*) filter (usable) as in_files, sum(length(contents)) filter (usable)::bigint as n_chars from c""",
    "group_differences": """
select event_type, user_id % 4 as quarter, count(*) as n, round(avg(value - event_id * 37 % 101 / 2.0::double), 6) as mean_diff from events where event_id % 17 <> 0 and value is not null group by 1, 2""",
    "adjusted_p": """
with p as (select s_suppkey, s_nationkey, case when s_suppkey % 9 <> 0 then s_suppkey * 7919 % 1009 / 20000.0::double end as p from supplier),
r as (select *, count(p) over (partition by s_nationkey) as n, row_number() over (partition by s_nationkey order by p nulls last) as i from p)
select s_suppkey, case when p is not null then round(least(1.0, max(p * (n - i + 1)) over (partition by s_nationkey order by i)), 9) end as p_holm,
  case when p is not null then round(least(1.0, min(p * n / i) over (partition by s_nationkey order by i desc)), 9) end as p_bh from r""",
    "link_overrides": f"""
with d as ({more_queries.ORACLE_SQL["link_decisions"]}),
part_names as (select p_name as mention, min(p_partkey) as k from part group by 1),
m as (select mention, k % 3 = 0 as typed, k, case when k % 5 = 0 then 'S' || k end as steel, case when k % 10 = 0 then 'D' || k end as other from part_names),
f as (select mention, case when typed then coalesce(steel, other) else other end as fix from m union all select 'no such part', null)
select mention, coalesce(fix, entity_id) as entity_id, case when fix is not null then 0.95::double else score end as score, case when fix is not null then 0.5::double else margin end as margin,
  case when fix is null then coalesce(abstained, case when score is null then 'no candidates' end) end as abstained from f left join d using (mention)""",
    "context_confidence": """
with n as (select count(*) as n from embeddings),
s as (select vec_id as key, label, unnest([vec_id, (vec_id * 3 + 1) % n, (vec_id * 5 + 2) % n]) as entity from embeddings, n where vec_id % 7 <> 0),
first as (select label, arg_min(embedding, vec_id) as v from embeddings group by label),
c as (select s.key, case when e.vec_id % 5 <> 0 and s.key % 11 <> 0 then greatest(0.0, (list_cosine_similarity(e.embedding::double[], f.v::double[]) + 1) / 2)
  when s.entity % 3 <> 0 then s.entity % 10 / 10.0::double else 0.0 end as x from s join embeddings e on e.vec_id = s.entity join first f on f.label = s.label)
select e.vec_id as key, round(coalesce(avg(x), 0.0), 6) as confidence from embeddings e left join c on c.key = e.vec_id group by 1""",
}
