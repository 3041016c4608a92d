"""Queries of column functions that no other query reaches, over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions import parsers as P
from ragloom.functions import text as X
from ragloom.operators import kg
from ragloom.operators import retrieval as R
from ragloom.operators import reward
from ragloom.operators import training as G
from ragloom.plans import kg_queries, rag
from ragloom.tables import table


def text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, some with Chinese characters put at the end: flags, estimates and keys."""
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("中文"))).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    asked = P.prefixed(F.substring("text", 1, 20), True)
    return rows.select("doc_id", P.has_chinese(F.col("text")).alias("chinese"), P.token_estimate(F.col("text")).alias("tokens"), P.content_key(F.col("text")).alias("key"), F.sha2(asked, 256).alias("asked_sha256"))


def entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's discounts as log-probabilities; one in five has none."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(-F.col("l_discount") * F.col("l_linenumber")).alias("x"))
    logprobs = F.when(F.col("l_orderkey") % 5 == 0, F.array().cast("array<double>")).otherwise(F.col("x"))
    return rows.select("l_orderkey", F.round(reward.entropy(logprobs), 9).alias("entropy"))


def vector_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against its label's first; a seventh are taken for missing."""
    rows = table(spark, sf_dir, "embeddings")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    own = F.when(F.col("vec_id") % 7 != 0, F.col("embedding"))
    return rows.join(first, "label").select("vec_id", F.round(R.cosine(own, F.col("first")), 6).alias("cosine"))


def pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as sixteen tokens of four components: the mean of those that its id's mask leaves, and the first one."""
    rows = table(spark, sf_dir, "embeddings").where("size(embedding) = 64")
    tokens = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.slice(F.col("embedding"), t * 4 + 1, F.lit(4)))
    mask = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: ((F.col("vec_id") + t) % 3 != 0).cast("int"))
    each = rows.select("vec_id", F.explode(F.arrays_zip(R.pooled(tokens, mask).alias("mean"), R.pooled(tokens, mask, "cls").alias("first"))).alias("x"))
    return each.groupBy("vec_id").agg(F.round(F.sum("x.mean"), 6).alias("mean_sum"), F.round(F.max("x.mean"), 6).alias("mean_max"), F.round(F.sum("x.first"), 6).alias("first_sum"))


def path_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of each order with the highest discount, ties to the first."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("path"), F.col("l_discount").alias("score"))
    return rag.best_path(rows)


def relation_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hop edges of the questions' seeds by two relations only."""
    seeds = kg_queries.questions(spark, sf_dir).select("qid", "seed")
    edges = kg_queries.edges(spark, sf_dir)
    return kg.one_hop(seeds, edges, relations=["country", "instance of"]).select("qid", "pos", "h", "r", "t")


def accepted_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as traces with a decision that may be missing."""
    decided = F.when(F.col("doc_id") % 3 == 0, True).when(F.col("doc_id") % 3 == 1, False)
    return G.accepted(table(spark, sf_dir, "documents").select("doc_id", "source", decided.alias("accepted"))).select("doc_id", "source")


def long_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of 40 characters and more of each document."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.filter(X.sentences(F.col("text"), 40), lambda s: s.isNotNull()).alias("s"))
    return rows.select("doc_id", F.size("s").alias("n"), F.sha2(F.array_join("s", "|"), 256).alias("sentences_sha256"))


QUERIES = {f.__name__: f for f in (text_flags, entropies, vector_cosines, pooled_vectors, path_choice, relation_whitelist, accepted_traces, long_sentences)}

ORACLE_SQL = {
    "relation_whitelist": f"""with {kg_queries._GRAPH.split("one as (")[0].rstrip().rstrip(",")}
select qid, pos, h, r, t from (select qid, h, r, t, row_number() over (partition by qid order by r, t, h) as pos from questions join edges on seed = h where r in ('country', 'instance of')) where pos <= 30""",
    "text_flags": """
with t as (select doc_id, case when doc_id % 5 = 0 then text || '中文' else text end as text from documents)
select doc_id, doc_id % 5 = 0 and text is not null as chinese, length(text) // 4 as tokens, sha256(text) as key, sha256('query: ' || text[1:20]) as asked_sha256 from t""",
    "entropies": """
select l_orderkey, round(case when l_orderkey % 5 = 0 then 1.0 else greatest(0.0, avg(l_discount * l_linenumber)) end, 9) as entropy from lineitem group by 1""",
    "vector_cosines": """
with f as (select label, arg_min(embedding, vec_id) as first from embeddings group by 1)
select vec_id, case when vec_id % 7 = 0 then 0.0 else round(list_cosine_similarity(embedding::double[], first::double[]), 6) end as cosine from embeddings join f using (label)""",
    "pooled_vectors": """
with t as (select vec_id, unnest(range(16)) as t, embedding from embeddings where len(embedding) = 64),
d as (select vec_id, t, unnest(range(1, 5)) as d, unnest(embedding[t * 4 + 1:t * 4 + 4])::double as x from t),
m as (select vec_id, d, sum(x * ((vec_id + t) % 3 <> 0)::int) / greatest(count(*) filter ((vec_id + t) % 3 <> 0), 1e-9) as m, max(x) filter (t = 0) as f from d group by 1, 2),
n as (select vec_id, greatest(sqrt(sum(m * m)), 1e-12) as nm, greatest(sqrt(sum(f * f)), 1e-12) as nf from m group by 1)
select vec_id, round(sum(m / nm), 6) as mean_sum, round(max(m / nm), 6) as mean_max, round(sum(f / nf), 6) as first_sum from m join n using (vec_id) group by 1""",
    "path_choice": """
select qid, path, score from (select l_orderkey as qid, l_linenumber as path, l_discount as score, row_number() over (partition by l_orderkey order by l_discount desc, l_linenumber) as nth from lineitem) where nth = 1""",
    "accepted_traces": "select doc_id, source from documents where doc_id % 3 = 0",
    "long_sentences": r"""
with p as (select doc_id, string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) as p from documents)
select doc_id, len(list_filter(p, lambda s: length(s) >= 40))::int as n, sha256(array_to_string(list_filter(p, lambda s: length(s) >= 40), '|')) as sentences_sha256 from p""",
}
