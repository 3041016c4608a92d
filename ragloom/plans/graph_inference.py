"""Answers with a graph beside the passages, and what the graph was worth: retrieval, linking, subgraphs, prompts, generation and telemetry as one chain of DataFrames.

``generate`` adds ``answer``, a trace of steps with a final answer, to rows with ``qid`` and ``prompt`` (see ``rag.batched``).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.functions import text as X
from ragloom.operators import index as I
from ragloom.operators import joins, kg, reward, traces
from ragloom.operators import retrieval as R
from ragloom.plans.rag import Step
from ragloom.session import cut

# Mentions of a question that are linked, triples in a prompt, and passages.
MENTIONS, TRIPLES, PASSAGES = 8, 30, 15


class Inference(NamedTuple):
    """What a run gives; all tables have ``qid``."""

    answers: DataFrame  # prompt, raw, pred, severed
    graph: DataFrame  # pos, h, r, t: as the prompt had it
    gates: DataFrame  # step, density, confidence, alpha: a row for each step
    summary: DataFrame  # n_steps, alpha_mean, alpha_std, n_negative, hallucinated: a row for each question


def question_graph(questions: DataFrame, entities: DataFrame, edges: DataFrame, severed: DataFrame | None = None, most: int = TRIPLES) -> DataFrame:
    """``qid``, ``pos``, ``h``, ``r``, ``t``: the severed graph of a question that has one (qid, pos, h, r, t), else the edges of up to two hops round the entities that its mentions link to.

    Seeds are labels of ``entities`` (label, entity_id), as ``edges`` (h, r, t) go by; a mention without an entity has no seed.
    """
    asked = questions if severed is None else questions.join(severed.select("qid").distinct(), "qid", "left_anti")
    mentions = asked.select("qid", F.posexplode(X.mentions(F.col("text"), MENTIONS)).alias("place", "mention"))
    linked = kg.link(mentions, entities).where("qid_linked is not null")
    labels = entities.groupBy(F.col("entity_id").alias("qid_linked")).agg(F.min("label").alias("seed"))
    found = kg.merged_hops(linked.join(labels, "qid_linked").select("qid", "seed", "place"), edges).select("qid", "pos", "h", "r", "t")
    if severed is not None:
        found = found.unionByName(severed.join(questions.select("qid"), "qid", "left_semi").select("qid", F.col("pos").cast("long").alias("pos"), "h", "r", "t"))
    return found.where(F.col("pos") <= most)


def prompts(questions: DataFrame, passages: DataFrame, graph: DataFrame) -> DataFrame:
    """``qid`` and ``prompt``: numbered passages (qid, rank, text), triples, the question. A part that a question has none of is left out."""
    listed = lambda rows, order, line, name: rows.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n").alias(name))
    told = listed(passages, "rank", F.concat(F.lit("["), "rank", F.lit("] "), "text"), "passages")
    known = listed(graph, "pos", F.concat(F.lit("("), "h", F.lit(", "), "r", F.lit(", "), "t", F.lit(")")), "triples")
    part = lambda head, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(head), c, F.lit("\n\n"))).otherwise("")
    rows = questions.join(told, "qid", "left").join(known, "qid", "left")
    return rows.select("qid", F.concat(part("Retrieved Passages:\n", "passages"), part("Knowledge Graph Triples:\n", "triples"), F.lit("Question: "), "text").alias("prompt"))


def step_gates(raw: DataFrame, graph: DataFrame, entities: DataFrame) -> DataFrame:
    """``qid``, ``step``, ``density``, ``confidence``, ``alpha`` of each step of the traces (qid, raw); without log-probabilities the entropy is 1.

    Density is the question's graph's; confidence the mean over the step's mentions of how sure each is linked, 0 without any.
    """
    steps = raw.select("qid", F.explode(X.steps(F.coalesce("raw", F.lit("")))).alias("s")).select("qid", F.col("s.index").alias("step"), X.mentions(F.col("s.body")).alias("entities"))
    each = steps.select("qid", "step", F.explode("entities").alias("mention"))
    sure = joins.link_confidence(each, entities).groupBy("mention").agg(F.max("confidence").alias("confidence"))
    means = each.join(sure, "mention", "left").groupBy("qid", "step").agg(F.avg(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))
    rows = steps.join(means, ["qid", "step"], "left").join(kg.density(graph, ["qid"]).select("qid", "density"), "qid", "left")
    rows = rows.select("qid", "step", F.coalesce("density", F.lit(0.0)).alias("density"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    return rows.withColumn("alpha", reward.alpha(F.col("density"), F.col("confidence"), F.lit(1.0)))


def infer(docs: DataFrame, questions: DataFrame, generate: Step, entities: DataFrame, edges: DataFrame, severed: DataFrame | None = None, with_graph: bool = True, k: int = PASSAGES, most: int = TRIPLES, search: I.Search | None = None) -> Inference:
    """Answers questions (qid, text) from the ``k`` best passages of ``docs`` and up to ``most`` triples, with telemetry; ``with_graph`` false leaves the graph out of everything.

    A question without a graph has no share of hallucinated steps (null), one without steps 0 of both means.
    """
    hits = R.with_texts(search(questions, k) if search else R.bm25(docs, questions, k), docs).select("qid", "rank", "text")
    graph = cut(question_graph(questions, entities, edges, severed, most))
    graph = graph if with_graph else graph.limit(0)
    raw = cut(generate(prompts(questions.select("qid", "text"), hits, graph)).select("qid", "prompt", F.col("answer").alias("raw")))
    gone = severed.select("qid").distinct().withColumn("severed", F.lit(True)) if severed is not None else None
    answers = raw.withColumn("pred", X.clean_final_answer(F.coalesce(X.final_answer(F.col("raw")), F.col("raw"), F.lit(""))))
    answers = answers.withColumn("severed", F.lit(False)) if gone is None else answers.join(gone, "qid", "left").withColumn("severed", F.coalesce("severed", F.lit(False)))
    gates = cut(step_gates(raw, graph, entities))
    bodies = raw.select("qid", F.explode(X.steps(F.coalesce("raw", F.lit("")))).alias("s")).select("qid", F.col("s.index").alias("index"), F.col("s.body").alias("body"), F.lit(False).alias("discourse"))
    labels = traces.labelled_steps(bodies, graph)
    negative = labels.groupBy("qid").agg(F.count_if(F.col("label") == -1).alias("n_negative"), F.avg((F.col("label") == -1).cast("double")).alias("share"))
    stats = gates.groupBy("qid").agg(F.count(F.lit(1)).alias("n_steps"), F.avg("alpha").alias("alpha_mean"), F.stddev_pop("alpha").alias("alpha_std"))
    has = graph.select("qid").distinct().withColumn("has_graph", F.lit(True))
    rows = questions.select("qid").join(stats, "qid", "left").join(negative, "qid", "left").join(has, "qid", "left")
    known = lambda c, other: F.when(F.col("has_graph"), F.coalesce(c, F.lit(0.0))).otherwise(other)
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    n_negative = F.when(F.col("has_graph"), F.coalesce("n_negative", F.lit(0))).otherwise(0).alias("n_negative")
    summary = rows.select("qid", F.coalesce("n_steps", F.lit(0)).alias("n_steps"), zero("alpha_mean"), zero("alpha_std"), n_negative, known("share", None).alias("hallucinated"))
    return Inference(answers, graph, gates, summary)
