"""Smaller rules against loops: rates of tokens, context BM25, golden answers of a data set."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ragloom.functions import fuzzy, metrics
from ragloom.operators import compress, curate, retrieval, stats, training


def test_token_rates_equal_a_walk(spark):
    rng = random.Random(8)
    tokens, segments, wanted = [], [], {}
    for key in range(25):
        sizes = [rng.randint(0, 7) for _ in range(rng.randint(1, 6))]
        sizes[0] = max(1, sizes[0])
        segs = [(key, s, n, 1.0 if rng.random() < 0.3 else rng.choice([0.2, 0.5]), None) for s, n in enumerate(sizes)]
        segs = [(*x[:4], x[3] != 1.0) for x in segs]
        letters = [x for x in segs for _ in range(x[2])]
        at, own = 0, []
        while at < len(letters):
            n = min(rng.randint(0, 4), len(letters) - at)
            met = list(dict.fromkeys(letters[at : at + max(n, 1)]))
            own.append((n, 1.0 if len(met) > 1 and not all(x[4] for x in met) else min(x[3] for x in met)))
            at += n
        tokens += [(key, i, n) for i, (n, _) in enumerate(own)]
        segments += segs
        for w in range(0, len(own), 4):
            runs = []
            for _, rate in own[w : w + 4]:
                if runs and runs[-1][1] == rate:
                    runs[-1][0] += 1
                else:
                    runs.append([1, rate])
            wanted.update({(key, w // 4, r): tuple(x) for r, x in enumerate(runs)})
    out = compress.token_rates(spark.createDataFrame(tokens, "key int, i int, n_chars int"), spark.createDataFrame(segments, "key int, s int, n_chars int, rate double, compress boolean"), 4)
    assert {(r.key, r.window, r.run): (r.n, r.rate) for r in out.collect()} == wanted


def test_context_bm25_equals_a_loop(spark):
    rng = random.Random(3)
    texts = {k: [" ".join(rng.choice("a b c d the".split()) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 6))] for k in range(12)}
    rows = [(k, i, t) for k, ts in texts.items() for i, t in enumerate(ts)]
    asked = [(k, "a the the z") for k in texts]
    got = {(r.key, r.i): (r.score, r["rank"]) for r in compress.bm25_order(spark.createDataFrame(rows, "key int, i int, text string"), spark.createDataFrame(asked, "key int, text string")).collect()}
    for k, ts in texts.items():
        docs = [t.split(" ") for t in ts]
        n, avgdl = len(docs), sum(map(len, docs)) / len(docs)
        vocabulary = {w for d in docs for w in d}
        idf = {w: math.log(n - sum(w in d for d in docs) + 0.5) - math.log(sum(w in d for d in docs) + 0.5) for w in vocabulary}
        mean = sum(idf.values()) / len(idf)
        idf = {w: 0.25 * mean if x < 0 else x for w, x in idf.items()}
        score = [sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avgdl)) for w in asked[0][1].split(" ")) for d in docs]
        order = sorted(range(n), key=lambda i: (-round(score[i], 9), i))
        assert all(got[k, i] == (pytest.approx(score[i], abs=1e-8), order.index(i) + 1) for i in range(n))


def test_golden_answers_of_a_data_set(spark):
    schema = "id int, choices array<string>, indexes array<int>, golden_answers array<string>"
    rows = [(1, ["a", "b"], [1], ["x"]), (2, ["c"], [0, 5], ["y"])]
    golds = lambda rows: {r.id: r.golds for r in metrics.data_set_golds(spark.createDataFrame(rows, schema)).collect()}
    assert golds(rows) == {1: ["b"], 2: ["c", None]}
    assert golds([*rows, (3, [], [0], ["z"])]) == {1: ["x"], 2: ["y"], 3: ["z"]}
    assert golds([*rows, (3, None, [0], ["z"])])[1] == ["x"]


def test_patterns_match_the_whole_answer(spark):
    df = spark.createDataFrame([("The 12!", ["[0-9]+"], 1.0), ("12 b", ["[0-9]+"], 0.0), ("New York", ["new (york|jersey)", "x"], 1.0), ("a|b", ["c|ab"], 1.0), ("x", [], 0.0)], "p string, g array<string>, w double")
    assert all(r.em == r.w for r in df.select("w", metrics.em_pattern(F.col("p"), F.col("g")).alias("em")).collect())


def test_verdicts_and_collapse(spark):
    df = spark.createDataFrame([(float("nan"),), (-0.1,), (50.1,), (1.0,), (12.0,), (0.5,), (20.0,), (None,)], "kl double")
    assert [r.v for r in df.select(stats.kl_verdict(F.col("kl")).alias("v")).collect()] == ["nan", "diverging", "diverging", "healthy", "healthy", "very low", "high", None]
    runs = {"gone": [0.3] * 4 + [0.0] * 4, "short": [0.3] * 3 + [0.0] * 4, "never": [0.01] * 4 + [0.0] * 4, "back": [0.3] * 5 + [0.0, 0.0, 0.1]}
    rows = spark.createDataFrame([(k, i, x) for k, xs in runs.items() for i, x in enumerate(xs)], "k string, i int, back double")
    assert {r.k: r.collapsed for r in stats.reward_collapse(rows, "k", "i", "back").collect()} == {"gone": True, "short": False, "never": False, "back": False}


@pytest.mark.parametrize("surplus", [-6, 0, 6])
def test_judgement_by_neighbours(spark, surplus):
    judged = [(i, True if surplus > 0 and i < surplus else False if surplus < 0 and i < -surplus else None) for i in range(20)]
    hits = [(q, d, r) for q, ds in {1: range(5), 2: range(15, 20), 3: (0, 15, 16, 17, 18)}.items() for r, d in enumerate(ds, 1)]
    out = retrieval.neighbour_judgement(spark.createDataFrame(hits, "qid int, doc_id int, rank int"), spark.createDataFrame(judged, "doc_id int, better boolean"), 5)
    point = {i: {True: 1, False: -1, None: 0}[b] for i, b in judged}
    wanted = {}
    for q in (1, 2, 3):
        own, share = sum(point[d] for k, d, _ in hits if k == q), int(sum(point.values()) * 5 / 20)
        wanted[q] = not (own < 0 and own <= share) if surplus < 0 else own > 0 and own >= share
    assert {r.qid: r.retrieve for r in out.collect()} == wanted


def test_resume_and_severed_items(spark):
    work, done = spark.range(10).withColumnRenamed("id", "k"), spark.createDataFrame([(1,), (3,), (3,)], "k long")
    assert [r.k for r in curate.resume(work, done, "k", 3).orderBy("k").collect()] == [0, 2, 4] and curate.resume(work, done, "k").count() == 8
    graph = spark.createDataFrame([("a", True), ("a", False), ("a", False)], "qid string, severed boolean")
    got = training.severed_items(spark.createDataFrame([("a",), ("b",)], "qid string"), graph, 2).collect()
    assert sorted(map(tuple, got)) == [("a", 3, 1, 2, False), ("b", 0, 0, 0, True)]


def test_rouge_l_equals_a_table(spark):
    def lcs(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    rng = random.Random(6)
    pairs = [(" ".join(rng.choice("A b c d".split()) for _ in range(rng.randint(0, 12))), " ".join(rng.choice("a B c e".split()) for _ in range(rng.randint(0, 12)))) for _ in range(60)] + [(None, "a"), ("a", None), ("a a", "A")]
    got = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, p string, g string").select("i", fuzzy.rouge_l("p", "g").alias("r")).collect()
    for r in got:
        a, b = ((x or "").lower().split() for x in pairs[r.i])
        assert r.r == pytest.approx(2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0)
