"""Queries of answer extraction, BLEU, context-aware linking and triple selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions import extract as E
from ragloom.functions import metrics as M
from ragloom.operators import compress, kg
from ragloom.plans import kg_queries, text_queries
from ragloom.sources import sinks
from ragloom.tables import table


def answer_extractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation text, marked by its turn in one of four ways, read by each extractor."""
    t = F.col("turn") % 4
    marked = F.when(t == 0, F.concat(F.lit("Question: x\n"), "text", F.lit("\nSo the final answer is: Rome \nend")))
    marked = marked.when(t == 1, F.concat("text", F.lit(" So the answer is: Oslo\n"))).when(t == 2, F.concat(F.lit("<ANSWER> Bonn \n</answer>"), "text")).otherwise(F.concat(F.lit("Answer: B or C\n"), "text"))
    rows = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", marked.alias("p"))
    digest = lambda c: F.sha2(c, 256)
    return rows.select(
        "conv_id", "turn", E.self_ask(F.col("p")).alias("self_ask"), digest(E.chain_of_thought(F.col("p"))).alias("chain"), digest(E.first_line(F.col("p"))).alias("first_line"),
        digest(E.content_line(F.col("p"))).alias("content_line"), digest(E.tagged(F.col("p"))).alias("tagged"), E.last_choice(F.col("p")).alias("choice"),
    )


def bleu_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU of each assistant text, as it stands, against its own start and the turn before it."""
    pairs = text_queries.answer_pairs(spark, sf_dir).select("pred", F.concat(F.substring("pred", 1, 60), F.lit("-\n&quot;1,5-2.&quot; "), "gold").alias("gold"))
    out = M.bleu(pairs)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as mentions, the parts of that name as candidates described by type and brand."""
    part = table(spark, sf_dir, "part")
    described = part.groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("k"))
    return described.select(
        F.col("p_name").alias("mention"), F.concat(F.lit("Which steel "), "p_name", F.lit(" is small and brushed")).alias("question"), F.concat(F.lit("Q"), "k").alias("entity_id"),
        F.when(F.col("k") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" item"))).alias("label"), F.when(F.col("k") % 11 == 0, F.lit("Wikimedia list")).otherwise(F.col("p_type")).alias("description"),
        F.array(F.lit("steel"), F.lit("brass")).alias("expected_types"),
    )


def link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kg.link_scores(_candidates(spark, sf_dir)).select("mention", "entity_id", F.round("score", 9).alias("score"))


def link_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kg.link_decisions(link_candidates(spark, sf_dir))
    return out.select("mention", "entity_id", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"), "abstained")


def relevant_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = kg_queries.questions(spark, sf_dir).select("qid", F.col("question").alias("context"))
    return kg.relevant_triples(kg_queries.kg_merged_hops(spark, sf_dir), asked, 5).select("qid", "rank", "h", "r", "t", "overlap")


def cited_triples_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision of citations: each question cites its one-hop edges, upper-cased, and one that no graph has."""
    graph = kg_queries.kg_one_hop(spark, sf_dir).select("qid", "h", "r", "t")
    cited = graph.select("qid", F.upper("h").alias("h"), "r", F.upper("t").alias("t")).unionByName(kg_queries.questions(spark, sf_dir).select("qid", F.col("seed").alias("h"), F.lit("owner").alias("r"), F.lit("nobody").alias("t")))
    return kg.triples_in_graph(cited, graph).groupBy("qid").agg(F.count(F.lit(1)).alias("n_cited"), F.count_if("verified").alias("n_verified"))


def metric_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of a metric by method and dataset, as a report shows them."""
    return sinks.mean_std_pivot(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_discount", ["F", "O"])


def dropout_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples and severed triples of each relation, where those that touch ASIA are severed."""
    hit = (F.lower("h") == "asia") | (F.lower("t") == "asia")
    return kg_queries.edges(spark, sf_dir).groupBy("r").agg(F.count(F.lit(1)).alias("n_original"), F.count_if(hit).alias("n_severed"))


def information_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("i"), "value")
    return compress.information_mask(rows, 0.4).select("key", "i", "kept")


def word_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as tokens, every third id starting a word, errors forced."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("i"), (F.col("event_id") % 100 / 100.0).alias("p"), "event_type")
    out = compress.word_probabilities(rows, F.col("i") % 3 == 0, F.col("event_type") == "error")
    return out.select("key", "word", "n_tokens", F.round("p", 9).alias("p"))


def fitting_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as passages of so many tokens."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("i"), (F.col("o_orderkey") % 97).alias("tokens"))
    return compress.fitting_prefix(rows, 150)


def sparkline_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", "value")
    return compress.scaled(rows, "key", "value").select("key", "event_id", "level")


QUERIES = {
    f.__name__: f
    for f in (
        answer_extractors, bleu_corpus, link_candidates, link_decisions, relevant_triples, cited_triples_verified, metric_pivot, dropout_counts, information_mask, word_probabilities, fitting_prefix,
        sparkline_levels,
    )
}

_CAND = r"""
c as (select p_name as mention, 'Which steel ' || p_name || ' is small and brushed' as question, 'Q' || k as entity_id, case when k % 2 = 0 then p_name else p_name || ' item' end as label,
  case when k % 11 = 0 then 'Wikimedia list' else p_type end as description from (select p_name, p_type, min(p_partkey) as k from part group by 1, 2)),
w as (select *, lower(label) as l, lower(mention) as m, lower(description) as d, list_distinct(list_filter(string_split_regex(lower(description), '\s+'), lambda x: x <> '')) as dw,
  list_distinct(list_filter(string_split_regex(lower(question), '\s+'), lambda x: x <> '')) as qw from c),
s as (select mention, entity_id, round(greatest(0.0, least(1.0, (case when l = m then 0.30 when contains(l, m) or contains(m, l) then 0.20 else 0.10 end)::double
  + 0.30::double * least(1.0, len(list_intersect(dw, qw))::double / greatest(1, len(dw))) + (case when contains(d, 'steel') or contains(d, 'brass') then 0.20 else 0.0 end)::double
  - (case when d = 'wikimedia list' then 0.50 else 0.0 end)::double)), 9) as score from w)"""
def _bleu_tokens(text: str) -> str:
    """DuckDB: the tokens of ``metrics.bleu_tokens``."""
    out = f"replace(replace(replace({text}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for name, sign in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = f"replace({out}, '{name}', '{sign}')"
    out = f"' ' || {out} || ' '"
    for pattern, repl in ((r"([{-~\[-` -&(-+:-@/])", r" \1 "), (r"([^0-9])([.,])", r"\1 \2 "), (r"([.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        out = f"regexp_replace({out}, '{pattern}', '{repl}', 'g')"
    return f"list_filter(string_split_regex({out}, '\\s+'), lambda w: w <> '')"


_ENDS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE_SQL = {
    "answer_extractors": rf"""
with m as (select conv_id, turn, case turn % 4 when 0 then 'Question: x' || chr(10) || text || chr(10) || 'So the final answer is: Rome ' || chr(10) || 'end' when 1 then text || ' So the answer is: Oslo' || chr(10)
  when 2 then '<ANSWER> Bonn ' || chr(10) || '</answer>' || text else 'Answer: B or C' || chr(10) || text end as p from conversations where text is not null),
l as (select *, string_split(p, chr(10)) as raw, list_filter(list_transform(string_split(p, chr(10)), lambda x: trim(x, {_ENDS})), lambda x: x <> '') as lines from m)
select conv_id, turn,
  coalesce(trim(string_split(list_filter(raw, lambda x: contains(x, 'So the final answer is: '))[1], 'So the final answer is: ')[2], {_ENDS}), '') as self_ask,
  sha256(case when contains(p, 'So the answer is:') then trim(string_split(p, 'So the answer is:')[2], {_ENDS}) else p end) as chain,
  sha256(trim(raw[1], {_ENDS})) as first_line,
  sha256(coalesce(list_filter(lines, lambda x: not starts_with(x, 'Question:') and not starts_with(x, 'Answer:') and length(x) > 3)[1], lines[1], '')) as content_line,
  sha256(case when regexp_matches(p, '(?is)<answer>.*?</answer>') then trim(regexp_extract(p, '(?is)<answer>\s*(.*?)\s*</answer>', 1), {_ENDS})
    else coalesce(trim(regexp_replace(list_filter(lines, lambda x: regexp_matches(x, '(?i)^(answer|final answer)\s*[:：]'))[1], '(?i)^(answer|final answer)\s*[:：]\s*', ''), {_ENDS}), lines[-1], '') end) as tagged,
  coalesce(regexp_extract_all(p, '[A-D]')[-1], '') as choice from l""",
    "bleu_corpus": f"""with {text_queries._PAIRS},
raw as (select row_number() over () as id, pred, pred[1:60] || '-' || chr(10) || '&quot;1,5-2.&quot; ' || gold as gold from pairs),
t as (select id, {_bleu_tokens("pred")} as tp, {_bleu_tokens("gold")} as tg from raw),
n as (select unnest([1, 2, 3, 4]) as n),
grams as (select id, n, list_transform(range(1, len(tp) - n + 2), lambda i: array_to_string(tp[i:i + n - 1], ' ')) as p, list_transform(range(1, len(tg) - n + 2), lambda i: array_to_string(tg[i:i + n - 1], ' ')) as g from t, n),
s as (select n, sum(coalesce({text_queries._MACROS_SAME}, 0))::double / sum(len(p)) as p from grams group by n),
l as (select sum(len(tp))::double / sum(len(tg)) as ratio from t)
select round(case when min(p) > 0 then exp(avg(ln(p))) else 0.0 end * any_value(case when ratio > 1 then 1.0 else exp(1 - 1 / ratio) end), 9) as bleu, round(any_value(ratio), 9) as ratio,
  round(max(p) filter (n = 1), 9) as p1, round(max(p) filter (n = 2), 9) as p2, round(max(p) filter (n = 3), 9) as p3, round(max(p) filter (n = 4), 9) as p4 from s, l""",
    "link_candidates": f"with {_CAND} select mention, entity_id, score from s",
    "link_decisions": f"""with {_CAND},
r as (select *, lead(score) over (partition by mention order by score desc, entity_id) as second, row_number() over (partition by mention order by score desc, entity_id) as nth from s),
d as (select *, score - coalesce(second, 0.0) as margin, case when score < 0.15 then 'low score' when second is not null and score - second < 0.05::double then 'low margin' end as abstained from r where nth = 1)
select mention, case when abstained is null then entity_id end as entity_id, round(score, 6) as score, round(margin, 6) as margin, abstained from d""",
    "relevant_triples": f"""with {kg_queries._GRAPH},
o as (select m.*, len(list_intersect(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(h || ' ' || r || ' ' || t), '[a-z0-9]+'))))::int as overlap from merged m join questions using (qid))
select qid, rank, h, r, t, overlap from (select *, row_number() over (partition by qid order by overlap desc, pos) as rank from o) where rank <= 5""",
    "cited_triples_verified": f"""with {kg_queries._GRAPH}
select qid, count(h) + 1 as n_cited, count(h) as n_verified from questions left join (select qid, h from one) o using (qid) group by qid""",
    "metric_pivot": """
select l_returnflag, max(case when l_linestatus = 'F' then c end) as "F", max(case when l_linestatus = 'O' then c end) as "O" from (
  select l_returnflag, l_linestatus, printf('%.4f ± %.4f', avg(l_discount), coalesce(stddev_samp(l_discount), 0.0)) as c from lineitem group by 1, 2) group by 1""",
    "dropout_counts": f"with {kg_queries._GRAPH} select r, count(*) as n_original, count(*) filter (lower(h) = 'asia' or lower(t) = 'asia') as n_severed from edges group by r",
    "information_mask": """
select user_id as key, event_id as i, value >= c as kept from events join (select user_id as u, quantile_cont(value, 0.4) as c from events group by 1) on u = user_id""",
    "word_probabilities": """
with w as (select user_id as key, sum((event_id % 3 = 0)::int) over (partition by user_id order by event_id)::bigint as word, (event_id % 100)::double / 100 as p, event_type = 'error' as f from events)
select key, word, count(*) as n_tokens, round(case when bool_or(f) then 1.0 else avg(p) end, 9) as p from w group by 1, 2""",
    "fitting_prefix": """
with c as (select o_custkey as key, sum(o_orderkey % 97) over (partition by o_custkey order by o_orderkey) as s from orders)
select key, count(*) filter (s <= 150) as n_fit, coalesce(max(s) filter (s <= 150), 0)::bigint as tokens from c group by key""",
    "sparkline_levels": """
with e as (select user_id as u, min(value) as lo, max(value) as hi from events group by 1)
select user_id as key, event_id, case when hi > lo then floor((value - lo) / (hi - lo) * 7 + 0.5) else 0 end::bigint as level from events join e on u = user_id""",
}
