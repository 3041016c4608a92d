"""Queries of the trace rules, lookups, rerankings and parsers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions import parsers as P
from ragloom.operators import joins as J
from ragloom.operators import kg
from ragloom.operators import traces as T
from ragloom.plans import kg_queries
from ragloom.tables import table

#: A tail of a citation that makes it a triple of no graph.
WRONG = " of no known kind at all whatever"


def phrase_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a part's triple left a trace in a sentence, and the sentence's words with content."""
    rows = table(spark, sf_dir, "part").withColumn(
        "said", F.when(F.col("p_partkey") % 3 == 0, "Nothing of it.").otherwise(F.concat(F.lit("The '"), F.col("p_name"), F.lit("', it comes in "), F.col("p_type"), F.lit(".")))
    )
    found = T.triple_relevant(F.col("p_name"), F.lit("made by"), F.col("p_brand"), F.col("said"), F.lit(""))
    return rows.select("p_partkey", found.alias("relevant"), F.array_join(T.content_tokens(F.col("said")), " ").alias("tokens"))


def _talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as traces: (index, body, label) of each turn, in order."""
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    body = F.concat(F.lit(f"{T.REASONING} "), F.col("text"), F.lit(f"\n{T.CONCLUSION} done"))
    step = F.struct((F.col("turn") + 1).cast("int").alias("index"), body.alias("body"), F.when(F.col("turn") % 4 == 3, -1).otherwise(1).alias("label"), F.col("text"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))


def trace_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity, need of another try, and the text that an accepted trace is rendered to."""
    rows = _talks(spark, sf_dir).withColumn("answer", F.when(F.col("conv_id") % 5 != 0, F.lit("done ")))
    retry = T.needs_retry(F.size("steps"), F.col("conv_id") % 2, F.col("conv_id") % 3, 4)
    return rows.select("conv_id", T.is_valid(F.col("steps"), F.col("answer")).alias("valid"), retry.alias("retry"), F.sha2(T.rendered(F.col("steps"), F.col("answer")), 256).alias("rendered_sha256"))


def prefix_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _talks(spark, sf_dir).select("conv_id", F.posexplode(T.prefix_prompts(F.lit("Question"), F.transform("steps", lambda s: s["text"]))).alias("place", "prompt"))
    return rows.select("conv_id", F.col("place").cast("long").alias("place"), F.sha2("prompt", 256).alias("prompt_sha256"))


def step_labels_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of steps from their text: every edge of a question is cited in a step of its own, every third with a tail that no graph has, and the step after that with such a tail beside its own.

    Of five steps one concludes what the next one denies, so each is against the earlier of them.
    """
    graph = kg.one_hop(kg_queries.questions(spark, sf_dir).select("qid", "seed"), kg_queries.edges(spark, sf_dir))
    cite = lambda tail: F.concat(F.lit("("), "h", F.lit(", "), "r", F.lit(", "), tail, F.lit(")"))
    right, wrong = cite(F.col("t")), cite(F.concat("t", F.lit(WRONG)))
    cited = F.when(F.col("pos") % 3 == 0, wrong).when(F.col("pos") % 3 == 1, F.concat(right, F.lit(" "), wrong)).otherwise(right)
    told = F.when(F.col("pos") % 5 == 3, "the bridge stands over water").when(F.col("pos") % 5 == 4, "the bridge never stands over water").otherwise("it was found")
    body = F.concat(F.lit("Reasoning: we look at "), "h", F.lit(" and go on.\nConclusion: "), told, F.lit("\nKnowledge Used: "), cited)
    steps = graph.select("qid", F.col("pos").alias("index"), body.alias("body"), F.lit(False).alias("discourse"))
    return T.labelled_steps(steps, graph, least_graph=1).select("qid", "index", F.col("label").cast("double").alias("label"))


def hallucination_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of negative lines in each order; null where the order has no graph."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid"), (F.col("l_partkey") % 3 - 1).alias("label"), (F.col("l_orderkey") % 4).alias("n_graph"))
    return T.hallucination_rate(rows, F.col("n_graph")).select("qid", F.round("rate", 9).alias("rate"))


def graph_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "qid")
    index = rows.where("qid % 2 = 0").select("qid", F.array("c_name").alias("graph"))
    stored = rows.where("qid % 3 <> 0").select("qid", F.array("c_mktsegment", "c_name").alias("graph"))
    out = J.indexed_or_stored(rows.select("qid"), index, stored)
    return out.select("qid", F.array_join("graph", "|").alias("graph"), "from_index")


def subgraph_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cached triples of customers; suppliers' edges alone are cached for the others."""
    cache = kg_queries.edges(spark, sf_dir).where("r <> 'country' or h like 'Supplier%'").select(F.col("h").alias("seed"), "r", "t")
    seeds = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("qid"), F.col("s_name").alias("seed"))
    more = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("qid"), F.col("c_name").alias("seed"))
    return J.cached_subgraphs(seeds.unionByName(more), cache).select("qid", "seed", "r", "t")


def documents_of_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 3000).alias("doc_id"))
    return J.documents_of(hits, table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")).select("event_id", "doc_id", "source", "n_chars")


def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    docs = J.sparse_weights(rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("term"), (F.col("l_quantity") / 10.0 - 2.0).alias("logit")), "doc_id")
    asked = J.sparse_weights(rows.select(F.col("l_linenumber").alias("qid"), F.col("l_suppkey").alias("term"), (F.col("l_discount") * 10.0).alias("logit")), "qid")
    return J.sparse_topk(docs, asked).select("qid", "doc_id", "rank", F.round("score", 5).alias("score"))


def _source_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("qid"), F.col("l_returnflag").alias("source"), F.col("l_partkey").alias("doc_id"), F.col("l_linenumber").alias("rank"), F.col("l_quantity").cast("double").alias("score"))


def interleaved_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.interleaved(_source_hits(spark, sf_dir), 3)


def reordered_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.reordered(_source_hits(spark, sf_dir), 3)


def scored_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best lines of an order by a score; a model's pandas function goes in the same place."""
    return J.scored_rerank(_source_hits(spark, sf_dir).dropDuplicates(["qid", "doc_id"]).withColumn("n", F.col("doc_id") % 17), F.col("n") / 16.0, 3)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line number of an order."""
    least = [F.min(c).alias(c) for c in ("l_partkey", "l_discount", "l_tax", "l_quantity")]
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*least)


def beam_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of two lines of an order, where a line leads from one of three nodes to the next."""
    rows = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("n"), (F.col("l_linenumber") % 3).alias("h"), ((F.col("l_linenumber") + 1) % 3).alias("t"), "l_partkey")
    out = J.beam_chains(rows.select("qid", "n", "h", "t"), rows.select("qid", "n", ((F.col("l_partkey") % 10 + 1) / 11.0).alias("p")), 2, 3, 0.15)
    return out.select("qid", F.array_join("chain", "-").alias("chain"), F.round("score", 6).alias("score"))


def kl_token_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("i"), (-F.col("l_discount")).alias("logprob"), (-F.col("l_tax")).alias("ref_logprob"),
        (F.col("l_linenumber") > 1).cast("int").alias("mask"), F.col("l_quantity").cast("double").alias("score"),
    )
    steps = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("key"), F.explode(F.array(F.lit(1), F.lit(2)).cast("array<long>")).alias("nth"))
    return T.kl_rewards(rows, steps.withColumn("reward", F.col("nth") * 1.5), 0.1).select("key", "i", F.round("reward", 9).alias("reward"))


def parsed_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    k, name = F.col("c_custkey"), F.col("c_name")
    listed = F.concat(F.lit("Here:\n(a) "), name, F.lit(", or so\nand more (b) none"))
    said = F.when(k % 3 == 0, "Passage 1 it is").when(k % 3 == 1, "passage 2").otherwise("both")
    return rows.select(
        "c_custkey",
        F.round(P.rating(F.concat(F.lit("Fine. Total rating: "), (k % 10).cast("string"), F.lit(".5 of 10"))), 6).alias("rating"),
        F.array_join(P.candidates(listed), "|").alias("candidates"),
        P.preferred_passage(said).cast("double").alias("preferred"),
        P.subquery(F.concat(F.lit(' "Intermediate query 12: '), name, F.lit('" '))).alias("subquery"),
        P.prefixed(name, True).alias("encoded"),
        P.says_true(F.concat(F.lit("That is "), F.when(k % 2 == 0, "True").otherwise("wrong"))).cast("long").alias("says_true"),
        P.action(F.concat(F.lit("Thought: x\nAction: Search["), name, F.lit("]\nObservation: y")))["argument"].alias("argument"),
    )


def robust_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    found = T.robust_mentions(F.array(F.lit(" Reasoning"), F.col("p_brand"), F.lit(""), F.col("p_brand")), F.lit("Who made the Steel Wheel"), F.array(F.col("p_name"), F.lit("Therefore")))
    return rows.select("p_partkey", F.array_join(found, "|").alias("mentions"))


def token_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list((-F.abs("value") / 100.0))).alias("logprobs"))
    return rows.select("user_id", F.round(P.mean_confidence(F.col("logprobs")), 9).alias("confidence"))


def merged_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hop and two-hop triples of the customers as a static and a dynamic graph, united."""
    seeds, edges = kg_queries.questions(spark, sf_dir).select("qid", "seed"), kg_queries.edges(spark, sf_dir)
    return J.merged_graphs(kg.one_hop(seeds, edges), kg.two_hop(seeds, edges)).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))


def labels_and_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    chosen = T.chosen_texts(F.array("l_returnflag", "l_linestatus", F.lit("x")), F.array(F.col("l_linenumber") % 2, F.lit(7)))
    return rows.select(
        "l_orderkey", "l_linenumber", T.label_class(F.col("l_linenumber") - 3).cast("long").alias("label_class"), F.array_join(chosen, "|", "-").alias("chosen"),
        T.triple_text(F.col("l_returnflag"), F.lit("is"), F.col("l_linestatus")).alias("triple"),
    )


def embedding_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by equal name, or else by name in lower case."""
    known = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("name"), F.col("n_nationkey").alias("found"))
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.initcap("n_name").alias("name")).unionByName(table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("k"), F.col("r_name").alias("name")))
    return J.looked_up(asked, known, "name", "found").select("k", "name", "found")


QUERIES = {
    f.__name__: f
    for f in (
        phrase_relevance, trace_validity, prefix_prompts, step_labels_text, hallucination_rates, graph_fallback, subgraph_cache, documents_of_hits, sparse_topk, interleaved_hits, reordered_hits,
        scored_rerank, beam_chains, kl_token_rewards, parsed_outputs, robust_mentions, token_confidence, merged_graph, labels_and_choices, embedding_lookup,
    )
}

_PUNCT = r"'[!-/:-@\[-`{-~]'"
_BARE = lambda x: f"regexp_replace(lower({x}), {_PUNCT}, '', 'g')"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_HITS = "hits as (select l_orderkey as qid, l_returnflag as source, l_partkey as doc_id, l_linenumber as rank, l_quantity::double as score from lineitem)"
_LINES = "lines as (select l_orderkey, l_linenumber, min(l_partkey) as l_partkey, min(l_discount) as l_discount, min(l_tax) as l_tax, min(l_quantity) as l_quantity from lineitem group by 1, 2)"
ORACLE_SQL = {
    "phrase_relevance": rf"""
with s as (select *, case when p_partkey % 3 = 0 then 'Nothing of it.' else 'The ''' || p_name || ''', it comes in ' || p_type || '.' end as said from part),
b as (select *, {_BARE('said')} as t, {_BARE('p_name')} as h, {_BARE('p_brand')} as b from s)
select p_partkey, regexp_matches(t, '\b' || h || '\b') or regexp_matches(t, '\b' || b || '\b') or regexp_matches(t, '\bmade by\b') as relevant,
  array_to_string(list_filter(list_transform(range(1, len(w) + 1), lambda i: case when list_position(w, w[i]) = i and length(w[i]) >= 3 and w[i] not in ({_STOP}) then w[i] end), lambda x: x is not null), ' ') as tokens
from (select *, string_split_regex(t, '\s+') as w from b)""",
    "trace_validity": r"""
with t as (select conv_id, turn + 1 as i, text, turn % 4 = 3 as bad from conversations where text is not null),
n as (select *, sum((not bad)::int) over (partition by conv_id order by i) as k from t),
g as (select conv_id, count(*) as n, min(i) = 1 and max(i) = count(*) and count(distinct i) = count(*) as seq, bool_and(length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 20) as filled,
  string_agg('[Step ' || k || ']' || chr(10) || 'Reasoning: ' || text || chr(10) || 'Conclusion: done', chr(10) || chr(10) order by i) filter (not bad) as said from n group by conv_id)
select conv_id, (n >= 3 and conv_id % 5 <> 0 and seq and filled) as valid, (n < 4 or (conv_id % 3 > 0 and conv_id % 2 = 0)) as retry,
  sha256(array_to_string(list_filter([said, case when conv_id % 5 <> 0 then '[Final Answer]' || chr(10) || 'done' end], lambda x: x is not null), chr(10) || chr(10))) as rendered_sha256 from g""",
    "prefix_prompts": """
select conv_id, row_number() over (partition by conv_id order by turn) - 1 as place,
  sha256('Question' || coalesce(chr(10) || string_agg(text, chr(10)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), '')) as prompt_sha256 from conversations where text is not null""",
    "step_labels_text": f"""with {kg_queries._GRAPH}
select qid, pos as index, (case when pos % 5 = 4 or pos % 5 = 3 and pos > 4 then -1.0 when pos % 3 = 0 then 0.0 when pos % 3 = 1 then 0.5 else 1.0 end)::double as label from one""",
    "hallucination_rates": """
select l_orderkey as qid, case when max(l_orderkey % 4) > 0 then round(avg((l_partkey % 3 - 1 = -1)::int::double), 9) end as rate from lineitem group by 1""",
    "graph_fallback": """
select c_custkey as qid, case when c_custkey % 2 = 0 then c_name when c_custkey % 3 <> 0 then c_mktsegment || '|' || c_name end as graph, c_custkey % 2 = 0 as from_index from customer""",
    "subgraph_cache": """
select s_suppkey as qid, s_name as seed, 'country' as r, n_name as t from supplier join nation on s_nationkey = n_nationkey union all select c_custkey, c_name, null, null from customer""",
    "documents_of_hits": "select event_id, event_id % 3000 as doc_id, source, n_chars from events left join documents d on d.doc_id = event_id % 3000",
    "sparse_topk": """
with d as (select l_orderkey as doc_id, l_suppkey as term, round(max(ln(1 + greatest(0.0, l_quantity::double / 10.0::double - 2.0::double))), 4) as w from lineitem group by 1, 2),
q as (select l_linenumber as qid, l_suppkey as term, round(max(ln(1 + greatest(0.0, l_discount::double * 10.0::double))), 4) as w from lineitem group by 1, 2),
s as (select qid, doc_id, round(sum(q.w * d.w), 6) as score from q join d using (term) where q.w > 0 and d.w > 0 group by 1, 2)
select qid, doc_id, rank, round(score, 5) as score from (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from s) where rank <= 10""",
    "interleaved_hits": f"""
with {_HITS}, o as (select * from (select *, row_number() over (partition by qid, doc_id order by rank, source) as nth from hits) where nth = 1)
select qid, place, doc_id, source from (select *, row_number() over (partition by qid order by rank, source, doc_id) as place from o) where place <= 3""",
    "reordered_hits": f"""
with {_HITS}, o as (select * from (select *, row_number() over (partition by qid, doc_id order by score desc, source) as nth from hits) where nth = 1)
select qid, place, doc_id, score, source from (select *, row_number() over (partition by qid order by score desc, source, doc_id) as place from o) where place <= 3""",
    "scored_rerank": f"""
with {_HITS}, o as (select distinct qid, doc_id, round((doc_id % 17)::double / 16.0::double, 6) as score from hits)
select qid, doc_id, rank, score from (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from o) where rank <= 3""",
    "beam_chains": f"""
with {_LINES}, x as (select l_orderkey as qid, l_linenumber as n, l_linenumber % 3 as h, (l_linenumber + 1) % 3 as t, (l_partkey % 10 + 1)::double / 11.0::double as p from lines),
o as (select * from x where p >= 0.15::double),
b as (select * from (select *, row_number() over (partition by qid order by round(p, 9) desc, n) as k from o) where k <= 3),
g as (select b.qid, b.n as n1, o.n as n2, b.p * o.p as score from b join o on b.qid = o.qid and b.t = o.h and b.n <> o.n),
u as (select qid, n1, n2, score from g union all select qid, n, null, p from b where not exists (select 1 from g where g.qid = b.qid and g.n1 = b.n))
select qid, n1 || coalesce('-' || n2, '') as chain, round(score, 6) as score from (select *, row_number() over (partition by qid order by round(score, 9) desc, n1, n2 nulls first) as k from u) where k <= 3""",
    "kl_token_rewards": f"""
with {_LINES}, x as (select l_orderkey as key, l_linenumber as i, -0.1::double * (l_tax - l_discount)::double as kl, l_quantity::double as score,
  case when l_linenumber > 1 then sum((l_linenumber > 1)::int) over (partition by l_orderkey order by l_linenumber) end as nth, sum((l_linenumber > 1)::int) over (partition by l_orderkey) as last from lines)
select key, i, round(kl + case when key % 2 = 0 then case when nth <= 2 then nth * 1.5 else 0.0 end when nth = last then score else 0.0 end::double, 9) as reward from x""",
    "parsed_outputs": """
select c_custkey, round((c_custkey % 10 + 0.5)::double / 10, 6) as rating, c_name || ' or so|none' as candidates, (case c_custkey % 3 when 0 then 1.0 when 1 then 0.0 else 0.5 end)::double as preferred,
  c_name as subquery, 'query: ' || c_name as encoded, (c_custkey % 2 = 0)::bigint as says_true, c_name as argument from customer""",
    "robust_mentions": "select p_partkey, p_brand || '|Steel Wheel|' || p_name as mentions from part",
    "token_confidence": "select user_id, round(avg(exp(-abs(value) / 100.0::double)), 9) as confidence from events group by 1",
    "merged_graph": f"with {kg_queries._GRAPH} select qid, count(*) as n from merged group by qid",
    "labels_and_choices": """
select l_orderkey, l_linenumber, (case when l_linenumber - 3 between -1 and 1 then l_linenumber - 2 else 1 end)::bigint as label_class, case when l_linenumber % 2 = 0 then l_returnflag else l_linestatus end || '|-' as chosen,
  '<' || l_returnflag || '; is; ' || l_linestatus || '>' as triple from lineitem""",
    "embedding_lookup": """
with a as (select n_nationkey as k, n_name as up from nation union all select r_regionkey + 100, r_name from region)
select k, case when k < 100 then array_to_string(list_transform(string_split(lower(up), ' '), lambda w: upper(w[1]) || w[2:]), ' ') else up end as name, case when k < 100 then k end as found from a""",
}
