"""Knowledge-graph queries over a graph made of the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.operators import kg
from ragloom.operators import kg_tables as T
from ragloom.tables import table

#: Seeds and questions: one for each customer, and one for each part name.
CUSTOMER_QUESTION, PART_QUESTION = "Which country is {} located in", "Which manufacturer built the {} instance"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers in nations, nations in regions, parts with their types and makers; each edge once."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    part = table(spark, sf_dir, "part")

    def rows(df: DataFrame, h: str, r: str, t: str) -> DataFrame:
        return df.select(F.col(h).alias("h"), F.lit(r).alias("r"), F.col(t).alias("t"))

    customer = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    parts = [rows(part, "p_name", "instance of", "p_type"), rows(part, "p_name", "manufacturer", "p_brand")]
    places = [rows(customer, "c_name", "country", "n_name"), rows(supplier, "s_name", "country", "n_name"), rows(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), "n_name", "part of", "r_name")]
    out = places[0]
    for more in places[1:] + parts:
        out = out.unionByName(more)
    return out.distinct()


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    def made(names: DataFrame, template: str) -> DataFrame:
        before, after = template.split("{}")
        return names.distinct().select(F.col("seed").alias("qid"), "seed", F.concat(F.lit(before), F.col("seed"), F.lit(after)).alias("question"))

    customers = table(spark, sf_dir, "customer").select(F.col("c_name").alias("seed"))
    return made(customers, CUSTOMER_QUESTION).unionByName(made(table(spark, sf_dir, "part").select(F.col("p_name").alias("seed")), PART_QUESTION))


def kg_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kg.one_hop(questions(spark, sf_dir).select("qid", "seed"), edges(spark, sf_dir))


def kg_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kg.two_hop(questions(spark, sf_dir).select("qid", "seed"), edges(spark, sf_dir))


def kg_merged_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kg.merged_hops(questions(spark, sf_dir).select("qid", "seed"), edges(spark, sf_dir))


def kg_filter_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir)
    return kg.filter_and_rank(kg.merged_hops(asked.select("qid", "seed"), edges(spark, sf_dir)), asked)


def kg_index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of an index build: triples before, hard-deleted, dropped by quota and score, kept, and by question."""
    asked = questions(spark, sf_dir)
    all_rows = kg.merged_hops(asked.select("qid", "seed"), edges(spark, sf_dir))
    kept = kg.filter_and_rank(all_rows, asked).groupBy("qid").agg(F.count(F.lit(1)).alias("n_after"))
    gone = kg.is_hard_deleted(F.col("h"), F.col("r"), F.col("t"))
    before = all_rows.groupBy("qid").agg(F.count(F.lit(1)).alias("n_before"), F.count_if(gone).alias("n_deleted"))
    both = asked.select("qid").join(before, "qid", "left").join(kept, "qid", "left").na.fill(0)
    return both.agg(
        F.count(F.lit(1)).alias("questions"),
        F.sum("n_before").alias("n_before"),
        F.sum("n_deleted").alias("n_deleted"),
        F.sum(F.col("n_before") - F.col("n_deleted") - F.col("n_after")).alias("n_dropped"),
        F.sum("n_after").alias("n_after"),
        F.round(F.avg("n_before"), 6).alias("avg_before"),
        F.round(F.avg("n_after"), 6).alias("avg_after"),
    )


def kg_relation_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kg.relation_frequency(kg_merged_hops(spark, sf_dir))


def kg_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kg.density(kg_merged_hops(spark, sf_dir), ["qid"]).withColumn("density", F.round("density", 9))


def kg_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each region, the share of its customers' names that are cached as entities; every third nation's are."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    mentions = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    cache = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.upper("c_name").alias("label"), F.concat(F.lit("Q"), F.col("c_custkey")).alias("entity_id"))
    linked = kg.link(mentions.select("r_name", F.concat(F.lit(" "), F.col("c_name"), F.lit("  ")).alias("mention")), cache)
    return linked.groupBy("r_name").agg(F.count(F.lit(1)).alias("n_mentions"), F.count("qid_linked").alias("n_linked"), F.round(F.avg(F.col("qid_linked").isNotNull().cast("double")), 9).alias("coverage"))


def kg_last_wins_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kg.last_wins(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])


def kg_effective_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation's region, severed where the region has another name than expected."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    items = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.col("r_name").alias("original_kg"), F.when(F.length("r_name") > 4, F.upper(F.concat(F.lit("no "), F.col("r_name")))).alias("modified_kg"))
    return kg.effective_graph(items)


QUERIES = {f.__name__: f for f in (kg_one_hop, kg_two_hop, kg_merged_hops, kg_filter_rank, kg_index_counts, kg_relation_freq, kg_density, kg_coverage, kg_last_wins_cache, kg_effective_graph)}


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _rows(pairs) -> str:
    return ", ".join("(" + _quoted(p) + ")" for p in pairs)


_before, _after = CUSTOMER_QUESTION.split("{}")
_pbefore, _pafter = PART_QUESTION.split("{}")
_GRAPH = f"""
edges as (
  select c_name as h, 'country' as r, n_name as t from customer join nation on c_nationkey = n_nationkey
  union select s_name, 'country', n_name from supplier join nation on s_nationkey = n_nationkey
  union select n_name, 'part of', r_name from nation join region on n_regionkey = r_regionkey
  union select p_name, 'instance of', p_type from part
  union select p_name, 'manufacturer', p_brand from part),
questions as (
  select distinct c_name as qid, c_name as seed, '{_before}' || c_name || '{_after}' as question from customer
  union all select distinct p_name, p_name, '{_pbefore}' || p_name || '{_pafter}' from part),
one as (
  select qid, 1 as hop, pos, h, r, t from (
    select qid, h, r, t, row_number() over (partition by qid order by r, t, h) as pos from questions join edges on seed = h) where pos <= 30),
paths as (
  select * from (
    select qid, e.h, e.r, e.t, f.h as h2, f.r as r2, f.t as t2, row_number() over (partition by qid order by e.r, e.t, f.r, f.t, e.h) as n
    from questions join edges e on seed = e.h join edges f on e.t = f.h) where n <= 30),
two as (
  select qid, 2 as hop, 2 * n - 1 as pos, h, r, t from paths union all select qid, 2, 2 * n, h2, r2, t2 from paths),
merged as (
  select qid, hop, h, r, t, row_number() over (partition by qid order by hop, pos) as pos from (
    select *, row_number() over (partition by qid, h, r, t order by hop, pos) as nth from (select * from one union all select * from two)) where nth = 1)
"""
_GONE = f"""(h in ({_quoted(T.META_LABELS)}) or t in ({_quoted(T.META_LABELS)}) or r in ({_quoted(T.STOP_RELATIONS)})
  or lower(h) = lower(t) or trim(h) = '' or trim(r) = '' or trim(t) = '')"""


def _entity_sql(e: str) -> str:
    return f"""case when trim(lower({e})) = '' then 0.0 when contains(q, trim(lower({e}))) then 1.0
      when len(string_split_regex(trim(lower({e})), '\\s+')) >= 2 and contains(q, string_split_regex(trim(lower({e})), '\\s+')[-1]) then 0.5 else 0.0 end::double"""


_RANKED = f"""
pids(label, pid) as (values {_rows(T.RELATION_PIDS.items())}),
keywords(word, pid) as (values {_rows((w, p) for w, ps in T.KEYWORD_PIDS.items() for p in ps)}),
known as (
  select m.*, coalesce(nullif(regexp_extract(r, '^(P[0-9]+)', 1), ''), p.pid, '') as pid
  from merged m left join pids p on lower(m.r) = p.label where not {_GONE}),
quota as (
  select * from (select *, row_number() over (partition by qid, pid, h order by pos) as nth from known) where pid not in ('P31', 'P279') or nth <= 1),
shared as (
  select * from (
    select * exclude (nth), greatest(floor((count(*) over (partition by qid)) * 0.15::double), 1) as most, row_number() over (partition by qid, pid order by pos) as nth
    from quota) where nth <= most),
scored as (
  select qid, hop, pos, h, r, t, pid,
    0.30::double * greatest({_entity_sql('h')}, {_entity_sql('t')})
    + 0.25::double * (case when exists (select 1 from keywords k where k.pid = x.pid and contains(q, k.word)) then 1.0 else 0.0 end)::double
    + 0.25::double * (case when len(list_filter(string_split_regex(lower(r), '\\s+'), lambda w: length(w) > 2 and contains(q, w))) > 0 then 0.25 else 0.0 end)::double
    - (case pid when 'P31' then 0.35 when 'P279' then 0.35 when 'P527' then 0.20 when 'P361' then 0.15 else 0.0 end)::double as score
  from (select s.*, lower(question) as q from shared s join questions using (qid)) x),
best as (
  select *, pid in ('P31', 'P279') as tax, floor(least(30, count(*) over (partition by qid)) * 0.2::double) as most from (
    select *, row_number() over (partition by qid order by score desc, pos) as place from scored) where place <= 60),
capped as (
  select * from (select *, row_number() over (partition by qid, tax order by place) as nth from best) where not tax or nth <= most),
final as (
  select * from (select *, row_number() over (partition by qid order by score desc, tax desc, place) as rank from capped) where rank <= 30)
"""
ORACLE_SQL = {
    "kg_one_hop": f"with {_GRAPH} select qid, hop, pos, h, r, t from one",
    "kg_two_hop": f"with {_GRAPH} select qid, hop, pos, h, r, t from two",
    "kg_merged_hops": f"with {_GRAPH} select qid, hop, pos, h, r, t from merged",
    "kg_filter_rank": f"with {_GRAPH}, {_RANKED} select qid, rank, h, pid, r, t, round_even(score, 4) as score, hop from final",
    "kg_index_counts": f"""with {_GRAPH}, {_RANKED},
by_question as (
  select q.qid, coalesce(b.n, 0) as n_before, coalesce(b.d, 0) as n_deleted, coalesce(a.n, 0) as n_after
  from questions q left join (select qid, count(*) as n, count(*) filter ({_GONE}) as d from merged group by qid) b using (qid)
  left join (select qid, count(*) as n from final group by qid) a using (qid))
select count(*) as questions, sum(n_before)::bigint as n_before, sum(n_deleted)::bigint as n_deleted, sum(n_before - n_deleted - n_after)::bigint as n_dropped,
  sum(n_after)::bigint as n_after, round(avg(n_before), 6) as avg_before, round(avg(n_after), 6) as avg_after from by_question""",
    "kg_relation_freq": f"with {_GRAPH} select r, count(*) as n from merged group by r order by n desc, r limit 20",
    "kg_density": f"""with {_GRAPH},
nodes as (select qid, count(distinct node) as n_nodes from (select qid, h as node from merged union all select qid, t from merged) group by qid)
select qid, n_edges, n_nodes, round(n_edges / (n_nodes + 1e-6::double), 9) as density from (select qid, count(*) as n_edges from merged group by qid) join nodes using (qid)""",
    "kg_coverage": """
with cache as (select lower(trim(c_name)) as k, max('Q' || c_custkey) as e from customer where c_acctbal > 0 group by 1)
select r_name, count(*) as n_mentions, count(e) as n_linked, round(avg((e is not null)::int::double), 9) as coverage
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey left join cache on lower(trim(c_name)) = k group by r_name""",
    "kg_last_wins_cache": "select user_id, arg_max(event_type, (ts, event_id)) as event_type from events group by user_id",
    "kg_effective_graph": """
select n_name, r_name as original_kg, case when length(r_name) > 4 then upper('no ' || r_name) end as modified_kg,
  coalesce(case when length(r_name) > 4 then upper('no ' || r_name) end, r_name) as effective_kg
from nation join region on n_regionkey = r_regionkey""",
}
