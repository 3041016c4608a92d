"""Rules and joins that SQL can't express, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from ragloom.functions import fuzzy, parsers
from ragloom.operators import joins, kg, reward, traces


@pytest.mark.parametrize("cutoff", [70.0, 85.0])
def test_fuzzy_link_equals_all_pairs(spark, cutoff):
    rng = random.Random(5)
    labels = sorted({" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(1, 3))) for _ in range(80)})
    mentions = {"xustralia", "a", ""}
    for label in rng.sample(labels, 50):
        m = list(label)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(m) + 1)
            m[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
        words = "".join(m).split(" ")
        rng.shuffle(words)
        mentions.add(" ".join(words))
    labels.append("australia")
    wanted = {}
    for m in mentions:
        best = min(((-fuzzy.token_sort_ratio(m, x), x) for x in labels if m.split()), default=(0, None))
        wanted[m] = (best[1], pytest.approx(-best[0])) if -best[0] >= cutoff else (None, None)
    out = fuzzy.fuzzy_link(spark.createDataFrame([(m,) for m in mentions], "mention string"), spark.createDataFrame([(x,) for x in labels], "label string"), cutoff)
    assert {r.mention: (r.label, r.ratio) for r in out.collect()} == wanted
    assert wanted["xustralia"][0] == "australia"


def test_link_confidence(spark):
    entities = spark.createDataFrame([("Q1", "Australia"), ("Q2", "New Zealand")], "entity_id string, label string")
    mentions = spark.createDataFrame([("australia ",), ("Xustralia",), ("Nowhere",)], "mention string")
    found = {r.mention: (r.entity_id, round(r.confidence, 3)) for r in joins.link_confidence(mentions, entities).collect()}
    assert found == {"australia ": ("Q1", 1.0), "Xustralia": ("Q1", 0.889), "Nowhere": (None, 0.0)}


def test_fuzzy_citations(spark):
    graph = spark.createDataFrame([("q", "Albert Einstein", "born in", "Ulm"), ("q", "Ulm", "country", "Germany")], "qid string, h string, r string, t string")
    cited = [("q", "einstein albert", "born in", "ULM"), ("q", "Albert Einsten", "born in", "Ulm"), ("q", "Ulm", "country", "France"), ("p", "Ulm", "country", "Germany")]
    out = traces.verified_citations(spark.createDataFrame(cited, "qid string, h string, r string, t string"), graph)
    assert sorted((r.qid, r.h, r.verified) for r in out.collect()) == [("p", "Ulm", False), ("q", "Albert Einsten", True), ("q", "Ulm", False), ("q", "einstein albert", True)]


def test_labels_from_text(spark):
    graph = spark.createDataFrame([("q", "Ulm", "country", "Germany"), ("q", "Ulm", "part of", "Swabia"), ("q", "Bonn", "country", "Germany")], "qid string, h string, r string, t string")
    bodies = [
        "Reasoning: Ulm is a town.\nKnowledge Used: (Ulm, country, Germany)\nConclusion: the town belongs to Germany",
        "Reasoning: nothing here.\nKnowledge Used: (Bonn, country, Germany)\nConclusion: so it goes",
        "Reasoning: then again.\nConclusion: the town never belongs there",
        "Reasoning: then again.\nConclusion: the town does not have information, unknown",
        "Reasoning: Ulm.\nKnowledge Used: (Ulm, country, Peru) (Ulm, part of, Swabia)\nConclusion: fine",
    ]
    steps = spark.createDataFrame([("q", i + 1, b, False) for i, b in enumerate(bodies)], "qid string, index int, body string, discourse boolean")
    assert [r.label for r in traces.labelled_steps(steps, graph).orderBy("index").collect()] == [1.0, 0.0, -1.0, 0.0, 0.5]
    few = traces.labelled_steps(steps, graph.limit(2)).orderBy("index").collect()
    assert [r.label for r in few] == [0.0, 0.0, -1.0, 0.0, 0.0]


def test_validity(spark):
    def trace(*bodies, start=1):
        return [(start + i, b) for i, b in enumerate(bodies)]

    long = "Reasoning: long enough a thought to count"
    cases = [(trace(long, long, long), "x", True), (trace(long, long), "x", False), (trace(long, long, long), None, False), (trace(long, long, long, start=2), "x", False),
             (trace(long, "Reasoning: \nFinal Answer: a long answer that is no thought", long), "x", False), (trace(long, " ", long), "x", False), (trace("no label", "b", "c"), "x", True), ([], "x", False)]
    df = spark.createDataFrame([(i, s, a) for i, (s, a, _) in enumerate(cases)], "i int, steps array<struct<index:int,body:string>>, answer string")
    out = df.select("i", traces.is_valid(F.col("steps"), F.col("answer")).alias("v")).orderBy("i").collect()
    assert [r.v for r in out] == [w for *_, w in cases]


def test_long_trajectories_keep_their_digits(spark):
    n, gamma = 30_000, 0.95
    df = spark.range(n).select(F.lit(1).alias("key"), F.col("id").alias("step"), (F.col("id") % 7).cast("double").alias("reward"))
    got = {r.step: r.ret for r in reward.discounted_returns(df, gamma).collect()}
    cum = 0.0
    for i in reversed(range(n)):
        cum = i % 7 + gamma * cum
        assert got[i] == pytest.approx(cum, rel=1e-9)


@pytest.mark.parametrize("gamma,lam,n", [(0.95, 0.0, 5), (0.95, 0.05, 300), (0.0, 0.9, 5), (0.01, 1.0, 700), (1.0, 1.0, 2000), (0.99, 0.95, 10_000)])
def test_returns_and_advantages_for_any_gamma_and_lambda(spark, gamma, lam, n):
    steps = [("a", i, float(i % 5) - 1, float(i % 3)) for i in range(n)] + [("b", 0, 2.0, 0.5), ("c", 1, None, 1.0), ("c", 2, 3.0, 0.0)]
    df = spark.createDataFrame(steps, "key string, step int, reward double, value double").withColumn("delta", F.lit("kept"))
    got = {(r.key, r.step): r.ret for r in reward.discounted_returns(df, gamma).collect()}
    adv = {(r.key, r.step): (r.advantage, r.delta) for r in reward.gae(df.na.fill(0.0, ["reward"]), gamma, lam).collect()}
    ret, total, after = {}, {}, {}
    for key, step, r, v in reversed(steps):
        ret[key] = (r or 0.0) + gamma * ret.get(key, 0.0)
        total[key] = (r or 0.0) + gamma * after.get(key, 0.0) - v + gamma * lam * total.get(key, 0.0)
        after[key] = v
        assert got[key, step] == pytest.approx(ret[key], rel=1e-9, abs=1e-12) and adv[key, step] == (pytest.approx(total[key], rel=1e-9, abs=1e-9), "kept")
    with pytest.raises(ValueError):
        reward.discounted_returns(df, 1.5)


def test_columns_of_any_name_stay(spark):
    rows = spark.createDataFrame([("q", 1, "P1", "h", "r", "t", 1.0, "a", "b", "c", "d")], "qid string, pos int, pid string, h string, r string, t string, score double, nth string, most string, place string, taxonomic string")
    assert kg.quotas(rows).select("nth", "most").collect() == [("a", "b")]
    assert kg.taxonomic_cap(rows).select("nth", "most", "place", "taxonomic").collect() == [("a", "b", "c", "d")]
    named = rows.select("qid", "score", F.col("nth").alias("mean"), F.col("most").alias("var"), F.col("place").alias("std"))
    assert reward.whitened(named, "score").select("mean", "var").collect() == reward.group_advantage(named, "qid", "score").select("mean", "var").collect() == [("a", "b")]


def test_parsers(spark):
    df = spark.createDataFrame([("Thought: a\nAction: Look[x]\nAction: Find[y z]\nObservation: o", "Action: ```python\nprint(1)\n```", "none")], "a string, b string, c string")
    r = df.select(*[parsers.action(F.col(c)).alias(c) for c in "abc"], parsers.compression_distance("a", "a").alias("same"), parsers.compression_distance("a", "b").alias("other"), parsers.rating(F.col("c")).alias("none")).first()
    assert (r.a.name, r.a.argument) == ("Find", "y z") and (r.b.name, r.b.argument) == (None, "print(1)") and r.c is None and r.none is None
    assert r.same < r.other
