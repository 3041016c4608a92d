"""Joins by blocks and by rare keys, against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.functions import fuzzy
from ragloom.operators import joins
from ragloom.operators import retrieval as R


@pytest.mark.parametrize("query_rows,vector_rows", [(4096, 2048), (3, 7)])
def test_dense_equals_all_pairs_with_ties(spark, monkeypatch, query_rows, vector_rows):
    monkeypatch.setattr(R, "VECTOR_ROWS", vector_rows)
    monkeypatch.setattr(R, "QUERY_ROWS", 2)
    monkeypatch.setattr(R, "BLOCKS", 2)
    rng = np.random.default_rng(1)
    v = rng.integers(-2, 3, size=(60, 4)).astype(float)
    docs = [(f"d{i:02}", x.tolist()) for i, x in enumerate(v)] + [("none", None), ("d99", v[0].tolist())]
    asked = [(i, rng.integers(-2, 3, size=4).astype(float).tolist()) for i in range(20)] + [(50, None)]
    got = R.dense(spark.createDataFrame(docs, "doc_id string, v array<float>").repartition(3), spark.createDataFrame(asked, "qid int, v array<double>"), 5, query_rows).collect()
    found = sorted((r.qid, r.rank, r.doc_id, r.score) for r in got)
    wanted = []
    for q, x in asked[:-1]:
        best = sorted((-float(np.dot(x, y)), d) for d, y in docs if y is not None)[:5]
        wanted += [(q, r, d, -s) for r, (s, d) in enumerate(best, 1)]
    assert found == sorted(wanted)


def test_dense_of_empty_tables(spark):
    docs, asked = spark.createDataFrame([], "doc_id long, v array<float>"), spark.createDataFrame([(1, [1.0])], "qid int, v array<double>")
    assert R.dense(docs, asked).collect() == []
    assert R.dense(spark.createDataFrame([(1, [1.0])], "doc_id long, v array<float>"), asked.limit(0)).collect() == []


@pytest.mark.parametrize("most", [200_000, 0])
def test_sparse_by_broadcast_and_by_parts(spark, monkeypatch, most):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", most)
    rng = random.Random(2)
    docs = [(d, "hot", 1.0) for d in range(40)] + [(d, f"t{rng.randint(0, 9)}", float(k + 1)) for d in range(40) for k in range(2)]
    asked = [(q, "hot", 0.5) for q in range(5)] + [(q, f"t{q}", 2.0) for q in range(5)]
    got = joins.sparse_topk(spark.createDataFrame(docs, "doc_id int, term string, weight double").withColumn("part", F.lit("x")), spark.createDataFrame(asked, "qid int, term string, weight double"), 4)
    found = sorted((r.qid, r["rank"], r.doc_id, r.score) for r in got.collect())
    wanted = []
    for q in range(5):
        score = {d: sum(w * x for i, t, w in docs if i == d for p, u, x in asked if p == q and u == t) for d in range(40)}
        wanted += [(q, r, d, s) for r, (s, d) in enumerate([(-s, d) for s, d in sorted((-s, d) for d, s in score.items())[:4]], 1)]
    assert found == wanted


@pytest.mark.parametrize("cutoff", [67.0, 80.0, 95.0])
def test_fuzzy_links_with_hot_keys(spark, monkeypatch, cutoff):
    monkeypatch.setattr(fuzzy, "KEY_ROWS", 5)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aab") for _ in range(rng.randint(1, 6)))
    labels = sorted({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(70)} | {"x" * 400})
    mentions = sorted({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(40)} | {"x" * 380 + "y", "", " "})
    got = {r.mention: (r.label, r.ratio) for r in fuzzy.fuzzy_link(spark.createDataFrame([(m,) for m in mentions], "mention string"), spark.createDataFrame([(x,) for x in labels], "label string"), cutoff).collect()}
    for m in mentions:
        best = min(((-fuzzy.token_sort_ratio(m, x), x) for x in labels if fuzzy.token_sort_ratio(m, x) >= cutoff and m.split()), default=None)
        assert got[m] == ((best[1], pytest.approx(-best[0])) if best else (None, None))


def test_fuzzy_cutoff_is_bounded(spark):
    with pytest.raises(ValueError):
        fuzzy.fuzzy_link(spark.createDataFrame([("a",)], "mention string"), spark.createDataFrame([("a",)], "label string"), 60.0)


def test_sparse_scores_are_summed_where_the_document_is(spark, monkeypatch):
    from ragloom.operators import retrieval as R

    monkeypatch.setattr(R, "SCORED_ROWS", 50)
    docs = spark.range(3000).selectExpr("id as doc_id", "explode(array(1, 2, 3, 4)) as term", "double(1 + (id % 7))").toDF("doc_id", "term", "weight")
    asked = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (2, 3, -1.0), (3, 4, 0.0), (4, 9, 1.0)], "qid long, term int, weight double")
    got = {(r.qid, r.doc_id, r.rank, r.score) for r in joins.sparse_topk(docs, asked, 2).collect()}
    assert got == {(1, 6, 1, 7.0), (1, 13, 2, 7.0), (2, 0, 1, -1.0), (2, 7, 2, -1.0), (3, 0, 1, 0.0), (3, 1, 2, 0.0)}
