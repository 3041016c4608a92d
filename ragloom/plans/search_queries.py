"""Queries of searches over many chains of reasoning. Their models are deterministic; what they compute is beyond SQL and tested against plain versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.operators import reward
from ragloom.plans import graph_inference as G
from ragloom.plans import retrieval_queries, searches
from ragloom.tables import table


def word(text: Column, n: int | Column) -> Column:
    """The n-th word of a text, from 0, counted round."""
    words = F.split(F.trim(text), r"\s+")
    return F.get(words, F.pmod(F.lit(n) if isinstance(n, int) else n, F.size(words)).cast("int"))


def rewriting_model(rows: DataFrame) -> DataFrame:
    """A stand-in for a model that rewrites queries: words at places that depend on the prompt's hash; a response is one word, as sure as the hash says."""
    hash_ = F.crc32(F.encode("prompt", "utf-8"))
    query = F.concat(word(F.col("prompt"), hash_), F.lit(" "), word(F.col("prompt"), F.floor(hash_ / 7)), F.lit(" "), word(F.col("prompt"), 1), F.lit(searches.END))
    response = F.concat(F.lit(" "), word(F.col("prompt"), F.floor(hash_ / 11)), F.lit(searches.END))
    answer = F.when(F.endswith("prompt", F.lit(searches.RESPONSE)), response).otherwise(query)
    sure = F.log((hash_ % 100 + 1) / 101.0)
    return rows.withColumn("answer", answer).withColumn("logprobs", F.array(F.lit(-9.0), sure, sure / 2, F.lit(-9.0)))


def thinking_model(rows: DataFrame) -> DataFrame:
    """A stand-in for a model that thinks one thought: two words of the prompt; every third one is its last."""
    hash_ = F.crc32(F.encode("prompt", "utf-8"))
    thought = F.concat(word(F.col("prompt"), hash_), F.lit(" "), word(F.col("prompt"), F.floor(hash_ / 7)), F.lit("."))
    return rows.withColumn("answer", F.when(hash_ % 3 == 0, F.concat(F.lit(f"{searches.LAST_THOUGHT} "), thought)).otherwise(thought))


def sampling_model(rows: DataFrame) -> DataFrame:
    """A stand-in for a sampled model: what it says depends on the prompt and on the seed."""
    hash_ = F.crc32(F.encode(F.concat("prompt", F.lit("/"), F.col("seed").cast("string")), "utf-8"))
    final = F.endswith("prompt", F.lit("Final answer:"))
    said = F.when(final, word(F.col("prompt"), hash_ % 3 + 2)).otherwise(F.concat(F.lit('"'), word(F.col("prompt"), hash_), F.lit(" "), word(F.col("prompt"), F.floor(hash_ / 7)), F.lit('"')))
    return rows.withColumn("answer", said).withColumn("logprobs", F.array(-(hash_ % 50) / 10.0, -(hash_ % 7) / 10.0))


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return retrieval_queries._docs(spark, sf_dir), retrieval_queries._asked(spark, sf_dir)


def tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    best, _ = searches.tree_search(*_tables(spark, sf_dir), rewriting_model, depth=2, width=2, k=2)
    return best.select("qid", "answer", F.round("confidence", 9).alias("confidence"), F.array_join("path.steps", ".").alias("path"))


def tree_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries from each question to its best answer."""
    trail = searches.walked_back(*searches.tree_search(*_tables(spark, sf_dir), rewriting_model, depth=1, k=2))
    return trail.select("qid", "depth", "query", "answer", F.round("confidence", 9).alias("confidence"))


def interleaved_thoughts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = searches.interleaved_thoughts(*_tables(spark, sf_dir), thinking_model, rounds=2, k=3)
    return out.select("qid", "pred", "n_thoughts", F.array_join("docs", ",").alias("docs"))


def best_of_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searches.best_of(searches.chains(*_tables(spark, sf_dir), sampling_model, n=4, rounds=2, k=2))


def citing_model(rows: DataFrame) -> DataFrame:
    """A stand-in for a model that reasons over triples: it cites the first one, denies its own conclusion where the head's name says so, and answers with the tail; without a triple it answers with a word of the first passage."""
    triple = r"\(([^,()]+), ([^,()]+), ([^,()]+)\)"
    part = lambda i: F.regexp_extract("prompt", triple, i)
    denies = F.when(F.length(part(1)) % 3 == 0, "never stands").otherwise("stands")
    one = F.concat(F.lit("[Step 1]\nReasoning: we look at "), part(1), F.lit(" now\nConclusion: the thing stands there today\nKnowledge Used: "), F.regexp_extract("prompt", triple, 0))
    two = F.concat(F.lit("\n[Step 2]\nReasoning: again\nConclusion: the thing "), denies, F.lit(" there today\n[Final Answer]\n"), part(3))
    word_ = F.regexp_extract("prompt", r"\[1\] (\S+)", 1)
    return rows.withColumn("answer", F.when(part(1) != "", F.concat(one, two)).otherwise(F.concat(F.lit("[Step 1]\nReasoning: passages only\n[Final Answer]\n"), word_)))


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Parts as passages, questions by name, entities, edges, and severed graphs for a quarter of the names."""
    part = table(spark, sf_dir, "part").withColumn("name", F.initcap("p_name"))
    names = part.groupBy("name").agg(F.min("p_partkey").alias("k"))
    docs = part.select(F.col("p_partkey").alias("doc_id"), F.concat_ws(" ", "name", "p_brand").alias("text"))
    questions = names.select(F.col("k").alias("qid"), F.concat(F.lit("Which kind of thing is "), "name", F.lit(" and who made it?")).alias("text"))
    entities = names.select(F.col("name").alias("label"), F.concat(F.lit("Q"), "k").alias("entity_id"))
    kinds = part.select(F.col("name").alias("h"), F.lit("instance of").alias("r"), F.initcap("p_type").alias("t"))
    edges = kinds.unionByName(part.select(F.col("name").alias("h"), F.lit("manufacturer").alias("r"), F.col("p_brand").alias("t"))).distinct()
    severed = names.where("k % 4 = 0").select(F.col("k").alias("qid"), F.lit(1).alias("pos"), F.col("name").alias("h"), F.lit("made of").alias("r"), F.lit("Steel").alias("t"))
    return docs, questions, entities, edges, severed


def graph_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, questions, entities, edges, severed = _parts(spark, sf_dir)
    out = G.infer(docs, questions, citing_model, entities, edges, severed, k=3)
    rows = out.answers.select("qid", "pred", "severed").join(out.summary, "qid")
    return rows.select("qid", "pred", "severed", "n_steps", F.round("alpha_mean", 9).alias("alpha_mean"), F.round("alpha_std", 9).alias("alpha_std"), "n_negative", F.round("hallucinated", 9).alias("hallucinated"))


def plain_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same questions without a graph."""
    docs, questions, entities, edges, _ = _parts(spark, sf_dir)
    out = G.infer(docs, questions, citing_model, entities, edges, with_graph=False, k=3)
    return out.answers.select("qid", "pred").join(out.summary, "qid").select("qid", "pred", "n_steps", F.round("alpha_mean", 9).alias("alpha_mean"), "hallucinated")


QUERIES = {f.__name__: f for f in (tree_search, tree_trail, interleaved_thoughts, best_of_chains, graph_inference, plain_inference)}
def _alpha(density: str, confidence: str) -> str:
    w = [repr(x) + "::double" for x in (*reward.GATE_WEIGHTS, reward.GATE_BIAS, reward.GATE_TAU)]
    return f"(1 / (1 + exp(-({w[0]} * {density} + {w[1]} * {confidence} + {w[2]} + {w[3]}) / {w[4]})))"


_NAME = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_TYPE = _NAME.replace("p_name", "p_type")
ORACLE_SQL: dict[str, str] = {
    "graph_inference": f"""
with names as (select {_NAME} as name, min(p_partkey) as k from part group by 1),
edges as (select distinct {_NAME} as h, 'instance of' as r, {_TYPE} as t from part union select distinct {_NAME}, 'manufacturer', p_brand from part),
placed as (select h, t, row_number() over (partition by h order by r, t) as pos from edges),
graphs as (select k as qid, h, t, pos from names join placed on h = name where k % 4 <> 0 and pos <= 30 union all select k, name, 'Steel', 1 from names where k % 4 = 0),
sized as (select qid, any_value(h) as h, arg_min(t, pos) as pred, count(*) / (1 + count(distinct t) + 1e-6::double) as density from graphs group by qid),
alphas as (select *, {_alpha("density", "0.2::double")} as a, {_alpha("density", "0.0::double")} as b, (length(h) % 3 = 0)::bigint as n_negative from sized)
select qid, pred, qid % 4 = 0 as severed, 2::bigint as n_steps, round((a + b) / 2, 9) as alpha_mean, round(abs(a - b) / 2, 9) as alpha_std, n_negative, round(n_negative / 2.0::double, 9) as hallucinated from alphas""",
    "plain_inference": f"""
with names as (select {_NAME} as name, min(p_partkey) as k from part group by 1)
select k as qid, string_split(name, ' ')[1] as pred, 1::bigint as n_steps, round({_alpha("0.0::double", "0.0::double")}, 9) as alpha_mean, null::double as hallucinated from names""",
}
