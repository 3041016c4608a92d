"""Retrieval queries: the benchmark's texts are the queries, documents the passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragloom.functions import metrics as M
from ragloom.operators import index as I
from ragloom.operators import retrieval as R
from ragloom.plans.text_queries import _toolkit
from ragloom.session import scratch_path
from ragloom.tables import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", spread=True).select("doc_id", "text")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _with_text(hits: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_texts(hits, _docs(spark, sf_dir)).join(_asked(spark, sf_dir).withColumnRenamed("text", "query"), "qid")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25(_docs(spark, sf_dir), _asked(spark, sf_dir))


def bm25_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a stored index of the English documents, after the others were appended, and after the segments were merged."""
    rows, asked, path = table(spark, sf_dir, "documents", spread=True), _asked(spark, sf_dir), scratch_path(spark, "index")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    I.create(rows.where(english).select("doc_id", "text"), path, buckets=16)
    found = [I.bm25(spark, path, asked)]
    I.append(rows.where(~english).select("doc_id", "text"), path)
    found.append(I.bm25(spark, path, asked))
    I.merge(spark, path)
    found.append(I.bm25(spark, path, asked))
    first, second, third = (hits.withColumn("state", F.lit(state)) for hits, state in zip(found, ("created", "appended", "merged")))
    return first.unionByName(second).unionByName(third)


def _two_settings(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Hits of two parameter settings from the same postings."""
    p = R.postings(_docs(spark, sf_dir), _asked(spark, sf_dir))
    b = R.bm25_scored(p, k, k1=0.9, b=0.4).withColumn("source", F.lit("b"))
    return R.bm25_scored(p, k).withColumn("source", F.lit("a")).unionByName(b)


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parameter settings of BM25 as two sources."""
    return R.rrf(_two_settings(spark, sf_dir, 10), 10)


def hits_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.concat_hits(_two_settings(spark, sf_dir, 5))


def lexical_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lexical_rerank(_with_text(bm25_topk(spark, sf_dir), spark, sf_dir))


def pack_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.pack_budget(_with_text(bm25_topk(spark, sf_dir), spark, sf_dir).select("qid", "rank", "text"), 1000)
    return rows.select("qid", "rank", F.sha2("packed", 256).alias("packed_sha256"), "whole")


def recall_precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hit is right if its document holds the query's text, both normalised."""
    rows = _with_text(bm25_topk(spark, sf_dir), spark, sf_dir)
    ranked = rows.groupBy("qid").agg(F.array(F.first("query")).alias("golds"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("docs"))
    docs, golds = F.col("docs"), F.col("golds")
    return ranked.select("qid", M.recall_at(docs, golds, 3).alias("recall_at_3"), M.recall_at(docs, golds, 10).alias("recall_at_10"), F.round(M.precision_at(docs, golds, 10), 9).alias("precision_at_10"))


def retrieval_cache_aside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short queries are in the cache; the others are searched."""
    asked = _asked(spark, sf_dir)
    cache = R.bm25(_docs(spark, sf_dir), asked.where("length(text) < 120"), 20)
    return R.cache_aside(asked, cache, lambda q: R.bm25(_docs(spark, sf_dir), q, 3), 3)


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first vector of each label against all vectors."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    asked = rows.groupBy("label").agg(F.min_by("v", "vec_id").alias("v")).select(F.col("label").alias("qid"), "v")
    return R.dense(rows.select(F.col("vec_id").alias("doc_id"), "v"), asked)


def knn_label_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each label's first vector, its ten nearest others vote: how many are of the same label, and whether they win."""
    rows = table(spark, sf_dir, "embeddings")
    hits = dense_topk(spark, sf_dir).join(rows.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    out = hits.groupBy("qid").agg(F.count_if(F.col("label") == F.col("qid")).alias("same"), F.count_if(F.col("label") != F.col("qid")).alias("other"))
    return out.withColumn("wins", F.col("same") > F.col("other"))


def document_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains = R.bm25(_docs(spark, sf_dir), _asked(spark, sf_dir), 5).withColumn("qid", F.col("qid") % 10)
    return R.document_votes(chains)


def answer_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), F.col("event_type").alias("answer"), F.abs("value").alias("score"))
    return R.answer_vote(rows).withColumn("score", F.round("score", 6))


def replug_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("qid"), F.col("l_orderkey").alias("doc_id"), F.col("l_quantity").alias("doc_score"), F.col("l_returnflag").alias("token"), F.col("l_discount").alias("score"))
    return R.replug_mix(rows).withColumn("score", F.round("score", 9))


def max_score_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("qid"), F.col("l_partkey").alias("doc_id"), F.col("l_extendedprice").alias("score"))
    return R.max_merge(rows)


def best_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beam search of depth two: of each region, the three best nation-supplier paths by product of scores."""
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    first = region.join(nation, F.col("r_regionkey") == F.col("n_regionkey")).withColumn("s1", 1.0 / (1.0 + F.length("n_name")))
    beam = first.withColumn("nth", F.row_number().over(Window.partitionBy("r_name").orderBy(F.col("s1").desc(), "n_name"))).where("nth <= 3").drop("nth")
    paths = beam.join(supplier, F.col("n_nationkey") == F.col("s_nationkey")).withColumn("score", F.round(F.col("s1") / (1.0 + F.abs("s_acctbal")), 12))
    best = Window.partitionBy("r_name").orderBy(F.col("score").desc(), "s_suppkey")
    return paths.withColumn("rank", F.row_number().over(best).cast("long")).where("rank <= 3").select("r_name", "rank", "n_name", "s_suppkey", "score")


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_stored, rrf_fuse, hits_concat, lexical_rerank, pack_budget, recall_precision_at_k, retrieval_cache_aside, dense_topk, knn_label_vote, document_vote, answer_vote, replug_mix,
        max_score_merge, best_chain,
    )
}


def _bm25(name: str, k: int, k1: float = R.K1, b: float = R.B, where: str = "true") -> str:
    return f"""
{name} as (
  select * from (
    select *, row_number() over (partition by qid order by score desc, doc_id) as rank from (
      select a.qid, p.doc_id, round(sum(a.q * ln(1 + (w.n - d.df + 0.5::double) / (d.df + 0.5::double)) * (p.tf / (p.tf + {k1}::double * ({1.0 - b}::double + {b}::double * p.dl / w.avgdl)))), 6) as score
      from (select * from asked where {where}) a join posts p using (term) join (select term, count(*) as df from posts group by term) d using (term), whole w group by a.qid, p.doc_id)) where rank <= {k})"""


_POSTS = """
asked as (select qid, term, any_value(qtext) as qtext, count(*) as q from (select item_id as qid, text as qtext, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from benchmark) group by qid, term),
sized as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as terms from documents),
whole as (select count(*) as n, avg(len(terms)) as avgdl from sized),
posts as (select doc_id, term, any_value(dl) as dl, count(*) as tf from (select doc_id, len(terms) as dl, unnest(terms) as term from sized) group by doc_id, term)"""
_HITS = f"with {_POSTS}, {_bm25('hits', 10)}"
_TEXTS = "texts as (select h.qid, h.doc_id, h.rank, d.text, b.text as query from hits h join documents d using (doc_id) join benchmark b on b.item_id = h.qid)"
_RERANKED = """
w as (select qid, doc_id, lower(text) as t, greatest(1, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))) as len,
  unnest(list_filter(string_split_regex(lower(query), '\\s+'), lambda x: x <> '')) as term from texts),
c as (select qid, doc_id, term, any_value(len) as len, count(*) as q, any_value((length(t) - length(replace(t, term, ''))) / length(term)) as tf from w group by qid, doc_id, term),
d as (select qid, term, count(*) filter (tf > 0) as df from c group by qid, term),
n as (select qid, count(distinct doc_id) as n from hits group by qid),
s as (select qid, doc_id, round(sum(q * (tf / len) * (ln((n + 1)::double / (df + 1)) + 1)), 6) as score from c join d using (qid, term) join n using (qid) group by qid, doc_id)"""
_DENSE = """
with q as (select label as qid, arg_min(embedding, vec_id) as v from embeddings group by label),
s as (select qid, vec_id as doc_id, label, round(list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i]::double * embedding[i]::double)), 6) as score from q, embeddings),
hits as (select * from (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from s) where rank <= 10)"""
ORACLE_SQL = {
    "bm25_topk": f"{_HITS} select qid, doc_id, rank, score from hits",
    "bm25_stored": f"""
select qid, doc_id, rank, score, 'created' as state from (with {_POSTS.replace("from documents", "from documents where lang = 'en'")}, {_bm25('hits', 10)} select * from hits)
union all select qid, doc_id, rank, score, state from (with {_POSTS}, {_bm25('hits', 10)} select * from hits), (values ('appended'), ('merged')) as s(state)""",
    "rrf_fuse": f"""with {_POSTS}, {_bm25('a', 10)}, {_bm25('b', 10, 0.9, 0.4)},
f as (select qid, doc_id, round(sum(1.0::double / (60 + rank)), 12) as score from (select qid, doc_id, rank from a union all select qid, doc_id, rank from b) group by qid, doc_id)
select * from (select qid, doc_id, row_number() over (partition by qid order by score desc, doc_id) as rank, score from f) where rank <= 10""",
    "hits_concat": f"""with {_POSTS}, {_bm25('a', 5)}, {_bm25('b', 5, 0.9, 0.4)},
u as (select qid, doc_id, rank, 'a' as source from a union all select qid, doc_id, rank, 'b' from b),
f as (select * from (select *, row_number() over (partition by qid, doc_id order by source, rank) as nth from u) where nth = 1)
select qid, doc_id, row_number() over (partition by qid order by source, rank) as rank, source from f""",
    "lexical_rerank": f"""{_HITS}, {_TEXTS}, {_RERANKED}
select * from (select qid, doc_id, row_number() over (partition by qid order by score desc, doc_id) as rank, score from s) where rank <= 10""",
    "pack_budget": f"""{_HITS}, {_TEXTS},
p as (select qid, rank, text, text[1:1200] as part, length(text[1:1200]) // 4 as tokens from texts),
c as (select *, sum(tokens) over (partition by qid order by rank) as s, row_number() over (partition by qid order by rank) as nth from p),
k as (select *, case when s <= 1000 then text when s - tokens <= 1000 and 1000 - (s - tokens) > 200 then part[1:(1000 - (s - tokens)) * 4] || ' ...'
  when nth = 1 then part[1:4000] end as packed from c)
select qid, rank, sha256(packed) as packed_sha256, s <= 1000 as whole from k where packed is not null""",
    "recall_precision_at_k": f"""{_HITS}, {_TEXTS},
held as (select qid, rank, contains({_toolkit('text')}, {_toolkit('query')})::int::double as hit from texts)
select qid, coalesce(max(hit) filter (rank <= 3), 0.0) as recall_at_3, max(hit) as recall_at_10, round(avg(hit), 9) as precision_at_10 from held group by qid""",
    "retrieval_cache_aside": f"""with {_POSTS}, {_bm25('c', 20, where='length(qtext) < 120')}, {_bm25('m', 3, where='length(qtext) >= 120')}
select qid, doc_id, rank, score, true as cached from c where rank <= 3 union all select qid, doc_id, rank, score, false from m""",
    "dense_topk": f"{_DENSE} select qid, doc_id, rank, score from hits",
    "knn_label_vote": f"{_DENSE} select qid, count(*) filter (label = qid) as same, count(*) filter (label <> qid) as other, count(*) filter (label = qid) > count(*) filter (label <> qid) as wins from hits group by qid",
    "document_vote": f"with {_POSTS}, {_bm25('hits', 5)} select qid % 10 as qid, doc_id, count(*) as votes from hits group by 1, 2",
    "answer_vote": """
with s as (select user_id as qid, event_type as answer, sum(abs(value)) as score from events group by 1, 2)
select qid, answer, round(score, 6) as score from (select *, row_number() over (partition by qid order by round(score, 9) desc, answer) as nth from s) where nth = 1""",
    "replug_mix": """
select qid, token, round(sum(part), 9) as score from (
  select l_suppkey as qid, l_returnflag as token, l_discount * (l_quantity / sum(l_quantity) over (partition by l_suppkey, l_returnflag)) as part from lineitem) group by 1, 2""",
    "max_score_merge": "select l_suppkey as qid, l_partkey as doc_id, max(l_extendedprice) as score from lineitem group by 1, 2",
    "best_chain": """
with b as (select * from (select *, 1.0::double / (1.0 + length(n_name)) as s1, row_number() over (partition by r_name order by 1.0::double / (1.0 + length(n_name)) desc, n_name) as nth
  from region join nation on r_regionkey = n_regionkey) where nth <= 3),
p as (select r_name, n_name, s_suppkey, round(s1 / (1.0 + abs(s_acctbal)), 12) as score from b join supplier on n_nationkey = s_nationkey)
select * from (select r_name, row_number() over (partition by r_name order by score desc, s_suppkey) as rank, n_name, s_suppkey, score from p) where rank <= 3""",
}
