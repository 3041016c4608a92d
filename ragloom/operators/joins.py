"""Lookups, unions and rerankings of retrieval and graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragloom.functions.fuzzy import fuzzy_link
from ragloom.operators import kg
from ragloom.operators.retrieval import BROADCAST_ROWS, cosine, ranked_hits, scored_postings
from ragloom.session import cut


def cached_subgraphs(seeds: DataFrame, cache: DataFrame) -> DataFrame:
    """``seeds`` (qid, seed) with the triples of their seeds' cached subgraphs (seed, pos, h, r, t); a seed that isn't cached keeps a row without a triple."""
    return seeds.join(cache, "seed", "left")


def indexed_or_stored(questions: DataFrame, index: DataFrame, stored: DataFrame, key: str = "qid") -> DataFrame:
    """Each question's triples from the index, or its stored graph where the index lacks it: both sides have ``key`` and ``graph`` (an array)."""
    left = questions.join(index.select(key, F.col("graph").alias("indexed")), key, "left").join(stored.select(key, F.col("graph").alias("stored")), key, "left")
    return left.select(*questions.columns, F.coalesce("indexed", "stored").alias("graph"), F.col("indexed").isNotNull().alias("from_index"))


def documents_of(hits: DataFrame, corpus: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``hits`` with their documents' columns. Only documents that are hit are moved, each once."""
    wanted = corpus.join(hits.select(id_col).distinct(), id_col, "left_semi")
    return hits.join(wanted, id_col, "left")


#: Parts that a term's documents are dealt into where queries are too many to be broadcast.
TERM_PARTS = 32


def sparse_topk(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Exact top ``k`` by the inner product of sparse vectors: both sides are postings (doc_id or qid, term, weight).

    Up to ``BROADCAST_ROWS`` postings of queries go to the tasks, to which the documents' are dealt by document, so that each gives out its best only; more are joined by term and part of the
    documents, so a term that all documents have isn't one task.
    """
    asked = cut(queries.select("qid", "term", F.col("weight").alias("w")))
    if asked.count() <= BROADCAST_ROWS:
        return ranked_hits(scored_postings(docs, asked, k), k)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(TERM_PARTS)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(TERM_PARTS - 1)))
    joined = docs.select("doc_id", "term", "weight", part.alias("part")).join(asked.withColumn("part", each), ["term", "part"])
    return ranked_hits(joined.groupBy("qid", "doc_id").agg(F.sum(F.col("w") * F.col("weight")).alias("score")), k)


def sparse_weights(tokens: DataFrame, key: str, places: int = 4) -> DataFrame:
    """Postings from token logits (``key``, term, logit): the greatest log(1 + max(0, logit)) of each term, rounded; zeros go."""
    weight = F.round(F.max(F.log1p(F.greatest(F.lit(0.0), F.col("logit")))), places)
    return tokens.groupBy(key, "term").agg(weight.alias("weight")).where("weight > 0")


def scored_rerank(hits: DataFrame, score: Column, k: int) -> DataFrame:
    """The ``k`` best hits by a model's score, ties to the smaller doc_id; ``score`` may be a pandas function of the pair's texts."""
    return ranked_hits(hits.select("qid", "doc_id", score.alias("score")), k)


def looked_up(keys: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """``keys`` with ``value`` of the equal key, else of the smallest key that is equal in lower case."""
    low = table.groupBy(F.lower(key).alias("low_key")).agg(F.min_by(value, key).alias("low_value"))
    exact = table.groupBy(F.col(key).alias("same_key")).agg(F.min(value).alias("same_value"))
    joined = keys.join(exact, F.col(key) == F.col("same_key"), "left").join(low, F.lower(key) == F.col("low_key"), "left")
    return joined.select(*keys.columns, F.coalesce("same_value", "low_value").alias(value))


def link_confidence(mentions: DataFrame, entities: DataFrame, cutoff: float = 85.0) -> DataFrame:
    """``mention``, ``entity_id``, ``confidence``: 1 for an equal cleaned label, else the best ratio over the cutoff as a share, else 0."""
    exact = kg.link(mentions.select("mention").distinct(), entities)
    found, rest = exact.where("qid_linked is not null"), exact.where("qid_linked is null").select("mention")
    near = fuzzy_link(rest, entities.select("label"), cutoff).join(entities.groupBy("label").agg(F.max("entity_id").alias("entity_id")), "label", "left")
    near = near.select("mention", "entity_id", F.coalesce(F.col("ratio") / 100.0, F.lit(0.0)).alias("confidence"))
    return found.select("mention", F.col("qid_linked").alias("entity_id"), F.lit(1.0).alias("confidence")).unionByName(near)


def context_confidence(steps: DataFrame, vectors: DataFrame, contexts: DataFrame, exact: DataFrame) -> DataFrame:
    """``key`` and ``confidence`` of each step: the mean over its entities of (cos + 1) / 2, cut at 0, of the entity's vector and the step's context vector.

    ``steps``: key, entities (array); ``vectors``: entity, v; ``contexts``: key, v; ``exact``: entity, confidence, which counts where a vector is missing (0 where that is too). A step without
    entities has 0; an entity that a step has twice counts twice.
    """
    each = steps.select("key", F.explode("entities").alias("entity"))
    rows = each.join(vectors.select("entity", F.col("v").alias("own")), "entity", "left").join(contexts.select("key", F.col("v").alias("around")), "key", "left")
    rows = rows.join(exact.select("entity", F.col("confidence").alias("known")), "entity", "left")
    near = F.greatest(F.lit(0.0), (cosine(F.col("own"), F.col("around")) + 1.0) / 2.0)
    score = F.when(F.col("own").isNotNull() & F.col("around").isNotNull(), near).otherwise(F.coalesce("known", F.lit(0.0)))
    means = rows.groupBy("key").agg(F.avg(score).alias("confidence"))
    return steps.select("key").distinct().join(means, "key", "left").select("key", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def merged_graphs(static: DataFrame, dynamic: DataFrame) -> DataFrame:
    """The triples of both graphs, each once for a question."""
    columns = ["qid", "h", "r", "t"]
    return static.select(*columns).unionByName(dynamic.select(*columns)).distinct()


def interleaved(hits: DataFrame, k: int) -> DataFrame:
    """Hits of several sources in turn: all first places in order of source, then all second ones; each document at its first place, ``k`` in all.

    ``hits``: qid, source, doc_id, rank.
    """
    first = Window.partitionBy("qid", "doc_id").orderBy("rank", "source")
    once = hits.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank", "source", "doc_id")).cast("long")
    return once.withColumn("place", place).where(F.col("place") <= k).select("qid", "place", "doc_id", "source")


def reordered(hits: DataFrame, k: int) -> DataFrame:
    """Hits of all sources by score, best first, ties by source, then document; a document that two sources have counts once, at its best."""
    best = hits.groupBy("qid", "doc_id").agg(F.min_by(F.struct("score", "source"), F.struct(-F.col("score"), F.col("source"))).alias("x"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("x.score").desc(), "x.source", "doc_id")).cast("long")
    return best.withColumn("place", place).where(F.col("place") <= k).select("qid", "place", "doc_id", "x.score", "x.source")


def beam_chains(triples: DataFrame, scores: DataFrame, depth: int, width: int, least: float = 0.0) -> DataFrame:
    """The ``width`` best chains of up to ``depth`` triples for each question: qid, chain (array of triple numbers), score.

    ``triples``: qid, n, h, t; a chain goes on from a triple's tail to an unused triple with that head. ``scores``: qid, n, p, the triple's own chance, of which a
    chain's score is the product; triples under ``least`` are no option. A chain that can't go on stays as it is. Each round is one join and keeps ``width`` rows for a question.
    """
    options = triples.join(scores, ["qid", "n"]).where(F.col("p") >= least)
    best = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "chain")
    cut_to_width = lambda rows: rows.withColumn("place", F.row_number().over(best)).where(F.col("place") <= width).drop("place")
    beams = cut_to_width(options.select("qid", F.array("n").alias("chain"), F.col("t").alias("end"), F.col("p").alias("score")))
    nxt = options.select("qid", F.col("n").alias("n2"), F.col("h").alias("end"), F.col("t").alias("t2"), F.col("p").alias("p2"))
    for _ in range(depth - 1):
        grown = beams.join(nxt, ["qid", "end"]).where(~F.array_contains("chain", F.col("n2")))
        grown = grown.select("qid", F.concat("chain", F.array("n2")).alias("chain"), F.col("t2").alias("end"), (F.col("score") * F.col("p2")).alias("score"))
        went_on = grown.select("qid", F.slice("chain", F.lit(1), F.size("chain") - 1).alias("chain")).distinct()
        beams = cut_to_width(grown.unionByName(beams.join(went_on, ["qid", "chain"], "left_anti").select("qid", "chain", "end", "score")))
    return beams.select("qid", "chain", "score")
