"""Inference with a graph: severed graphs, questions without any, and traces that can't be read."""

import pytest
from pyspark.sql import functions as F

from ragloom.operators import reward
from ragloom.plans import graph_inference as G
from ragloom.plans import search_queries as Q


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(1, "Alpha Beta is here"), (2, "Gamma is there"), (3, None)], "doc_id long, text string")
    questions = spark.createDataFrame([(1, "Where is Alpha Beta?"), (2, "Where is Gamma and Alpha Beta?"), (3, "Where is nobody?"), (4, "Where is Gamma?")], "qid long, text string")
    entities = spark.createDataFrame([("Alpha Beta", "Q1"), ("Gamma", "Q2"), ("Delta", "Q3")], "label string, entity_id string")
    edges = spark.createDataFrame([("Alpha Beta", "in", "Delta"), ("Delta", "part of", "Gamma"), ("Gamma", "near", "Delta")], "h string, r string, t string")
    severed = spark.createDataFrame([(4, 1, "Gamma", "not in", "Nowhere"), (9, 1, "x", "y", "z")], "qid long, pos int, h string, r string, t string")
    return docs, questions, entities, edges, severed


def test_graphs_and_prompts(spark, tables):
    docs, questions, entities, edges, severed = tables
    out = G.infer(docs, questions, Q.citing_model, entities, edges, severed, k=2)
    graph = {}
    for r in out.graph.orderBy("qid", "pos").collect():
        graph.setdefault(r.qid, []).append((r.h, r.r, r.t))
    assert graph[1] == [("Alpha Beta", "in", "Delta"), ("Delta", "part of", "Gamma")] and graph[4] == [("Gamma", "not in", "Nowhere")]
    # Seeds in the order of the question's mentions.
    assert graph[2][:2] == [("Gamma", "near", "Delta"), ("Alpha Beta", "in", "Delta")] and 3 not in graph and 9 not in graph
    rows = {r.qid: r for r in out.answers.collect()}
    assert rows[1].prompt.startswith("Retrieved Passages:\n[1] Alpha Beta is here\n") and "(Alpha Beta, in, Delta)\n(Delta, part of, Gamma)\n\nQuestion: Where is Alpha Beta?" in rows[1].prompt
    assert "Knowledge Graph" not in rows[3].prompt and [rows[q].severed for q in (1, 2, 3, 4)] == [False, False, False, True]
    assert rows[1].pred == "Delta" and rows[4].pred == "Nowhere"


def test_telemetry(spark, tables):
    docs, questions, entities, edges, severed = tables
    out = G.infer(docs, questions, Q.citing_model, entities, edges, severed, k=2)
    gates = {(r.qid, r.step): r for r in out.gates.collect()}
    # Mentions of step 1: Reasoning, Alpha Beta, Conclusion, Knowledge Used, Delta, of which two are entities; three nodes and two edges.
    assert gates[1, 1].confidence == pytest.approx(2 / 5) and gates[1, 1].density == pytest.approx(2 / 3, abs=1e-6) and gates[1, 2].confidence == 0.0
    alpha = lambda d, c: spark.range(1).select(reward.alpha(F.lit(d), F.lit(c), F.lit(1.0))).first()[0]
    one, two = alpha(gates[1, 1].density, 0.4), alpha(gates[1, 1].density, 0.0)
    rows = {r.qid: r for r in out.summary.collect()}
    assert (rows[1].n_steps, rows[1].alpha_mean, rows[1].alpha_std) == (2, pytest.approx((one + two) / 2), pytest.approx(abs(one - two) / 2))
    assert rows[3].hallucinated is None and rows[3].n_negative == 0 and rows[3].n_steps == 1
    assert rows[2].n_negative == (len("Gamma") % 3 == 0) and rows[2].hallucinated == rows[2].n_negative / 2


def test_without_a_graph_and_with_unreadable_traces(spark, tables):
    docs, questions, entities, edges, severed = tables
    mute = lambda rows: rows.withColumn("answer", F.when(F.col("qid") == 1, F.lit("no trace")))
    out = G.infer(docs, questions, mute, entities, edges, with_graph=False, k=1)
    assert out.graph.isEmpty() and "Triples" not in "".join(r.prompt for r in out.answers.collect())
    assert {r.qid: r.pred for r in out.answers.collect()} == {1: "no trace", 2: "", 3: "", 4: ""}
    assert {(r.n_steps, r.alpha_mean, r.alpha_std, r.n_negative, r.hallucinated) for r in out.summary.collect()} == {(0, 0.0, 0.0, 0, None)}
