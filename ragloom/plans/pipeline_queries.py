"""Queries of the pipelines, of fuzzy matching and of the streaming folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions import fuzzy
from ragloom.operators import curate as C
from ragloom.plans import kg_queries, rag, retrieval_queries, text_queries, training_queries
from ragloom.streaming import folds
from ragloom.tables import table


def rag_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.sequential(retrieval_queries._docs(spark, sf_dir), retrieval_queries._asked(spark, sf_dir))


def rag_iterative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds; queries with a short answer are done after the first."""
    return rag.iterative(retrieval_queries._docs(spark, sf_dir), retrieval_queries._asked(spark, sf_dir), done=F.length("answer") < 40)


def rag_evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    golds = retrieval_queries._asked(spark, sf_dir).select("qid", F.array("text").alias("golden_answers"))
    return rag.evaluated(rag_sequential(spark, sf_dir), golds)


def sure_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each order as its summaries."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("score"))
    return rag.pairwise_wins(rows)


def self_rag_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda n: (F.col("l_partkey") % n + 1).cast("double")
    score = rag.critique_score(c(2), c(3), c(5), c(7), c(11), [c(n) for n in (4, 6, 8, 9, 10)])
    ask = rag.needs_retrieval(c(5), c(7), 0.5)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(score, 9).alias("critique"), ask.alias("retrieve"))


def flare_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as tokens with probabilities."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", (1 - F.col("l_discount") * 5).alias("p")))).alias("x"))
    out = rag.confident(F.transform("x", lambda x: x["l_returnflag"]), F.transform("x", lambda x: x["p"]), 0.6)
    return rows.select("l_orderkey", out["all"].alias("confident"), out["query"].alias("query"))


def keep_ratio_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("i"), F.col("value"))
    return rag.keep_ratio(rows, 0.3)


def fuzzy_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with a letter changed at any place, linked back to part names."""
    labels = table(spark, sf_dir, "part").select(F.lower("p_name").alias("label")).distinct()
    at = F.pmod(F.xxhash64("label"), F.length("label")).cast("int")
    mentions = labels.select(F.concat(F.substring("label", F.lit(1), at), F.lit("x"), F.substring("label", at + 2, F.length("label"))).alias("mention")).distinct()
    return fuzzy.fuzzy_link(mentions, labels)


def rouge_l_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_queries.answer_pairs(spark, sf_dir).select("conv_id", "turn", fuzzy.rouge_l("pred", "gold").alias("rouge_l"))


def stream_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.last_wins(folds.table_stream(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sums by type; the complete result, so no window waits for the watermark."""
    stream = folds.table_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = folds.windowed(stream, "ts", ["event_type"], "value").withColumn("total", F.round("total", 6)).withColumn("start", F.col("start").cast("timestamp_ntz"))
    path = folds.scratch_path(spark, "windows")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = rows.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path)


def stream_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    stream = folds.table_stream(spark, sf_dir, "documents").select("doc_id", "source", (n % 9).cast("int").alias("steps"), (n % 89 / 88.0).alias("f1"), (n % 13 / 12.0).alias("rate"))
    stream = stream.withColumn("bucket", F.when(C.quality_ok(F.col("steps"), F.col("f1")), C.bucket_of(F.col("rate"))))
    return folds.run_to_table(folds.quota(stream, "source", "doc_id"), "quota")


def entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-blind membership of cited triples in the graph: some cite a tail that the graph lacks, and only its country edges are known."""
    edges = kg_queries.edges(spark, sf_dir)
    tail = F.when(F.right("h", F.lit(1)).isin("0", "5"), F.lit("nowhere")).otherwise(F.col("t"))
    cited = edges.select(F.upper("h").alias("h"), "r", tail.alias("t"))
    known = edges.where("r = 'country'").select(*[F.lower(c).alias(f"k{c}") for c in ("h", "r", "t")])
    return cited.join(known, (F.lower("h") == F.col("kh")) & (F.lower("r") == F.col("kr")) & (F.lower("t") == F.col("kt")), "left_semi")


QUERIES = {
    f.__name__: f
    for f in (
        rag_sequential, rag_iterative, rag_evaluated, sure_pairwise, self_rag_score, flare_confidence, keep_ratio_tokens, fuzzy_link, rouge_l_pairs, stream_last_wins, stream_windows,
        stream_quota, entity_links,
    )
}

_U = {n: f"(l_partkey % {n} + 1)::double" for n in (2, 3, 4, 5, 6, 7, 8, 9, 10, 11)}
_WHOLE = f"({_U[4]} + {_U[6]} + {_U[8]} + {_U[9]} + {_U[10]})"
_RAG = f"""
with {retrieval_queries._POSTS}, {retrieval_queries._bm25("hits", 5)}, {retrieval_queries._TEXTS}, {retrieval_queries._RERANKED},
r as (select qid, doc_id, rank, d.text from (select qid, doc_id, row_number() over (partition by qid order by score desc, doc_id) as rank from s) join documents d using (doc_id) where rank <= 5),
p as (select qid, rank, text, text[1:1200] as part, length(text[1:1200]) // 4 as tokens from r),
b as (select *, sum(tokens) over (partition by qid order by rank) as upto, row_number() over (partition by qid order by rank) as nth from p),
k as (select qid, rank, case when nth = 1 and upto > 600 then part[1:2400] when upto <= 600 then text when upto - tokens <= 600 and 600 - (upto - tokens) > 200 then part[1:(600 - (upto - tokens)) * 4] || ' ...' end as packed from b),
j as (select qid, string_agg(packed, chr(10) order by rank) as passages from k where packed is not null group by qid),
answers as (select item_id as qid, string_split_regex(regexp_replace(trim(coalesce(passages, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1] as answer
  from benchmark left join j on j.qid = item_id)"""
ORACLE_SQL = {
    "rag_sequential": f"{_RAG} select qid, answer from answers",
    "sure_pairwise": """
select a.l_orderkey as qid, a.l_linenumber as i, sum(case when a.l_quantity > b.l_quantity then 1.0 when a.l_quantity = b.l_quantity then 0.5 else 0.0 end)::double as wins
from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber <> b.l_linenumber group by 1, 2""",
    "self_rag_score": f"""
select l_orderkey, l_linenumber, round({_U[2]} / ({_U[2]} + {_U[3]}) + ({_U[5]} + 0.5::double * {_U[7]}) / ({_U[5]} + {_U[7]} + {_U[11]})
  + 0.5::double * (-1.0::double * {_U[4]} / {_WHOLE} + -0.5::double * {_U[6]} / {_WHOLE} + 0.5::double * {_U[9]} / {_WHOLE} + {_U[10]} / {_WHOLE}), 9) as critique,
  {_U[5]} / ({_U[5]} + {_U[7]}) > 0.5 as retrieve from lineitem""",
    "flare_confidence": """
select l_orderkey, bool_and(1 - l_discount * 5 > 0.6) as confident, coalesce(string_agg(l_returnflag, ' ' order by l_linenumber, l_returnflag, 1 - l_discount * 5) filter (1 - l_discount * 5 > 0.6), '') as query from lineitem group by l_orderkey""",
    "keep_ratio_tokens": """
with p as (select user_id as key, event_id as i, value, row_number() over (partition by user_id order by value desc, event_id) as nth, count(*) over (partition by user_id) as n from events where value <> 10000.0)
select p.key, p.i, p.value from p join (select key, value as cutoff from p where nth = greatest(1, floor(n * 0.3::double))) c using (key) where p.value >= cutoff""",
    "stream_last_wins": "select user_id, arg_max(event_type, (ts, event_id)) as event_type from events group by user_id",
    "stream_windows": "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2",
    "stream_quota": training_queries.ORACLE_SQL["silver_quota"],
    "entity_links": """
select upper(h) as h, 'country' as r, t from (
  select distinct c_name as h, n_name as t from customer join nation on c_nationkey = n_nationkey union select s_name, n_name from supplier join nation on s_nationkey = n_nationkey)
where right(h, 1) not in ('0', '5')""",
}
