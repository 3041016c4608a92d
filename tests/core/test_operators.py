"""Literal fixtures, folds against plain Python, and properties."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.functions import fuzzy
from ragloom.functions import metrics as M
from ragloom.functions import text as X
from ragloom.operators import curate, kg, retrieval, reward, stats
from ragloom.plans import rag
from ragloom.sources import readers, sinks


def value(spark, column, **cells):
    names = list(cells)
    types = ", ".join(f"{n} {'array<string>' if isinstance(cells[n], list) else 'string'}" for n in names)
    return spark.createDataFrame([tuple(cells.values())], types).select(column.alias("x")).first().x


def test_normalisers_differ_by_order(spark):
    text = "The U.S. a-n test, an's"
    assert value(spark, X.norm_core(F.col("t")), t=text) == "us n test s"
    assert value(spark, X.norm_toolkit(F.col("t")), t=text) == "us test ans"
    assert value(spark, X.norm_toolkit(F.col("t")), t="The Beatles!") == "beatles"


def test_scores_of_literal_answers(spark):
    score = lambda c, p, g: value(spark, c, p=p, g=g)
    assert score(M.em(F.col("p"), F.col("g")), "The Paris.", ["paris", "x"]) == 1.0
    assert score(M.f1(F.col("p"), F.col("g")), "red red blue", ["red blue blue"]) == pytest.approx(2 / 3)
    assert score(M.toolkit_scores(F.col("p"), F.col("g"))["f1"], "yes", ["yes it is"]) == 0.0
    assert score(M.sub_em(F.col("p"), F.col("g")), "it is Paris, France", ["paris"]) == 1.0
    assert score(M.sub_em(F.col("p"), F.col("g")), "anything", ["the"]) == 1.0
    assert score(M.answer_match(F.col("p"), F.get("g", F.lit(0))), "The answer is Albert Einstein, a physicist", ["albert einstein"]) == 1.0
    assert score(M.answer_match(F.col("p"), F.get("g", F.lit(0))), "", ["x"]) == 0.0


def test_step_and_answer_parsers(spark):
    trace = "[Step 1]\nReasoning: a\n(Ed Wood, country, USA)\n### Step 2\nb\nStep 3: c\n[Final Answer]\nParis\n"
    steps = value(spark, X.steps(F.col("t")), t=trace)
    assert [(s["index"], s["body"].split("\n")[0]) for s in steps] == [(1, "Reasoning: a"), (2, "b"), (3, "c")]
    assert value(spark, X.final_answer(F.col("t")), t=trace) == "Paris"
    assert value(spark, X.final_answer(F.col("t")), t="[Final Answer] Rome") == "Rome"
    assert value(spark, X.final_answer(F.col("t")), t="<answer>no</answer>") is None
    assert value(spark, X.last_tag(F.col("t"), "answer"), t="<answer>a</answer> <answer> b </answer>") == "b"
    assert [tuple(t) for t in value(spark, X.cited_triples(F.col("t")), t="see [(A, r, B), (C D, s, E)]")] == [("A", "r", "B"), ("C D", "s", "E")]
    assert [tuple(t) for t in value(spark, X.angle_triples(F.col("t")), t="<a; b; r; c> <x; y>")] == [("a; b", "r", "c")]


def test_mentions(spark):
    assert value(spark, X.mentions(F.col("t"), 2), t="What did Ed Wood and New York City see in Al and Rome?") == ["Ed Wood", "New York City"]
    assert value(spark, X.question_entities(F.col("t")), t="Is Ed Wood like ED or Ed Wood or New York?") == ["Is Ed Wood", "Ed Wood", "New York"]
    assert value(spark, X.question_id(F.col("t")), t=" What? ") == value(spark, X.question_id(F.col("t")), t="what?")


def test_quotas_and_ranks_against_a_plain_fold(spark):
    rng = random.Random(1)
    relations = ["instance of", "subclass of", "country", "member of", "nonsense", "P50 author"]
    triples = [(f"h{rng.randint(0, 6)}", rng.choice(relations), f"t{rng.randint(0, 30)}") for _ in range(120)]
    rows = spark.createDataFrame([("q", 1, i + 1, *t) for i, t in enumerate(triples)], "qid string, hop int, pos long, h string, r string, t string")
    pid = {"instance of": "P31", "subclass of": "P279", "country": "P17", "member of": "P463", "nonsense": "", "P50 author": "P50"}
    seen, kept = set(), []
    for t in triples:
        p = pid[t[1]]
        if p in ("P31", "P279"):
            if (p, t[0]) in seen:
                continue
            seen.add((p, t[0]))
        kept.append(t)
    most, counts, wanted = max(int(len(kept) * 0.15), 1), {}, []
    for t in kept:
        p = pid[t[1]]
        if counts.get(p, 0) < most:
            counts[p] = counts.get(p, 0) + 1
            wanted.append(t)
    found = kg.quotas(rows.withColumn("pid", kg.pid_of(F.col("r")))).orderBy("pos").collect()
    assert [(r.h, r.r, r.t) for r in found] == wanted
    ranked = kg.filter_and_rank(rows, spark.createDataFrame([("q", "which country has h1")], "qid string, question string"), 10).orderBy("rank").collect()
    assert len(ranked) == 10 and [r.score for r in ranked] == sorted((r.score for r in ranked), reverse=True)
    assert sum(r.pid in ("P31", "P279") for r in ranked) <= 2


def test_hard_deletion(spark):
    rows = [("A", "country", "a"), ("A", "ISNI", "x"), ("Wikimedia list", "r", "t"), ("A", " ", "t"), ("A", "country", "B")]
    kept = spark.createDataFrame(rows, "h string, r string, t string").where(~kg.is_hard_deleted(F.col("h"), F.col("r"), F.col("t"))).collect()
    assert [tuple(r) for r in kept] == [("A", "country", "B")]


def test_pack_budget_rules(spark):
    def packed(lengths, most):
        rows = spark.createDataFrame([("q", i, "x" * n) for i, n in enumerate(lengths)], "qid string, rank int, text string")
        return [(r["rank"], len(r.packed), r.whole) for r in retrieval.pack_budget(rows, most).orderBy("rank").collect()]

    assert packed([400, 400, 400], 250) == [(0, 400, True), (1, 400, True)]
    assert packed([400, 1200, 8], 350) == [(0, 400, True), (1, 1004, False)]
    assert packed([1200], 100) == [(0, 400, False)]


def test_rrf_and_cache(spark):
    hits = spark.createDataFrame([("q", "a", 1, 1), ("q", "a", 2, 2), ("q", "b", 2, 1)], "qid string, source string, doc_id int, rank int")
    assert [(r.doc_id, r["rank"]) for r in retrieval.rrf(hits, 5).orderBy("rank").collect()] == [(2, 1), (1, 2)]


def test_returns_and_advantages_equal_folds(spark):
    rng = random.Random(2)
    steps = [(k, i, rng.random(), rng.random()) for k in range(3) for i in range(20)]
    df = spark.createDataFrame(steps, "key int, step int, reward double, value double")
    got = {(r.key, r.step): r.ret for r in reward.discounted_returns(df, 0.9).collect()}
    adv = {(r.key, r.step): r.advantage for r in reward.gae(df, 0.9, 0.8).collect()}
    for k in range(3):
        cum = gae = nxt = 0.0
        for _, i, r, v in reversed([s for s in steps if s[0] == k]):
            cum = r + 0.9 * cum
            gae = r + 0.9 * nxt - v + 0.72 * gae
            nxt = v
            assert got[k, i] == pytest.approx(cum) and adv[k, i] == pytest.approx(gae)


def test_gate_is_monotone(spark):
    df = spark.createDataFrame([(i / 10.0,) for i in range(11)], "x double").orderBy("x")
    up = [r.a for r in df.select(reward.alpha(F.col("x"), F.lit(0.5), F.lit(0.5)).alias("a")).collect()]
    down = [r.a for r in df.select(reward.alpha(F.lit(0.5), F.lit(0.5), F.col("x")).alias("a")).collect()]
    assert up == sorted(up) and down == sorted(down, reverse=True)


def test_outcomes(spark):
    steps = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (2, 1, 0.1)], "key int, step int, reward double")
    outcomes = spark.createDataFrame([(1, True, 1.0), (2, False, 1.0), (3, False, None), (4, True, 1.0)], "key int, valid boolean, em double")
    found = {(r.key, r.step): r.reward for r in reward.outcome_adjusted(steps, outcomes).collect()}
    assert found == {(1, 1): 0.5, (1, 2): 10.5, (2, 1): -9.9, (3, 0): -10.0}


def test_contradictions(spark):
    df = spark.createDataFrame([("Einstein was not born in Germany", ["Einstein was born in Germany"]), ("no information about Einstein born Germany", ["Einstein was born in Germany"])], "c string, p array<string>")
    assert [r.x for r in df.select(reward.is_contradiction(F.col("c"), F.col("p")).alias("x")).collect()] == [True, False]


def test_sequential_quota_equals_plain_fold(spark):
    rng = random.Random(3)
    rows = [(s, i, rng.choice(["kg_rich", "kg_medium", "kg_sparse", None])) for s in "ab" for i in range(60)]
    found = {(r.s, r.i): r.accepted for r in curate.stratified_quota(spark.createDataFrame(rows, "s string, i long, bucket string"), "s", "i").collect()}
    for s in "ab":
        counts = {"kg_rich": 0, "kg_medium": 0, "kg_sparse": 0}
        for _, i, b in (r for r in rows if r[0] == s):
            total, share = sum(counts.values()), {"kg_sparse": 0.25, "kg_medium": 0.35}.get(b)
            ok = b is not None and (total == 0 or share is None or counts[b] < share * (total + 1))
            if ok:
                counts[b] += 1
            assert found[s, i] == ok


def test_hash_sample_is_the_same_for_any_partitions(spark):
    df = spark.range(500).selectExpr("id", "id % 3 as g")
    a = sorted(r.id for r in curate.hash_sample(df, "id", F.lit(20), 1, "g").collect())
    assert len(a) == 60 and a == sorted(r.id for r in curate.hash_sample(df.repartition(11), "id", F.lit(20), 1, "g").collect())


def test_statistics(spark):
    assert stats.t_tail(2.0, 10) == pytest.approx(0.07338803477074, abs=1e-12)
    assert stats.t_quantile(0.975, 4) == pytest.approx(2.7764451051977987, abs=1e-9)
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, float(a), float(a - 0.3)) for i, a in enumerate(rng.normal(size=300))], "id int, a double, b double")
    jittered = rows.withColumn("b", F.col("b") + (F.col("id") % 7 - 3) / 10.0)
    out = stats.paired_bootstrap(jittered, "id", "a", "b", 300).first()
    again = stats.paired_bootstrap(jittered.repartition(9), "id", "a", "b", 300).first()
    assert out.low < out.mean_diff < out.high and out.p == 0.0
    assert out.low == pytest.approx(again.low) and out.high == pytest.approx(again.high)
    k = stats.kappa(spark.createDataFrame([(1, 1), (0, 0), (1, 0), (0, 0)], "a int, b int"), F.col("a"), F.col("b")).first()
    assert k.kappa == pytest.approx(0.5)


def test_fuzzy_ratio():
    assert fuzzy.token_sort_ratio("new york mets", "mets new york") == 100.0
    assert fuzzy.token_sort_ratio("abcd", "abxd") == pytest.approx(75.0)
    assert fuzzy.lcs_length("AGCAT", "GAC") == 2 and fuzzy.lcs_length("", "a") == 0


def test_iterative_queries_leave_when_done(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma. More text here."), (2, "delta beta words. Others.")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "alpha"), (2, "delta")], "qid int, text string")
    out = rag.iterative(docs, asked, done=F.col("qid") == 1)
    assert sorted((r.qid, r["round"]) for r in out.collect()) == [(1, 0), (2, 0), (2, 1)]


def test_model_adapter_builds_its_client_in_each_task(spark):
    step = rag.batched(lambda: lambda texts: [t.upper() for t in texts])
    assert step(spark.createDataFrame([("a",)], "prompt string")).first().answer == "A"


def test_readers_and_sinks(spark, tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        return str(path)

    cache = write("c.jsonl", '{"label": " Paris", "qid": "Q1"}\n\n{bad\n{"label": "paris", "qid": "Q90"}\n')
    assert [tuple(r) for r in readers.entity_cache(spark, cache).collect()] == [("paris", "Q90")]
    sub = write("s.jsonl", '{"key": "k", "triples": [["a", "r", "b"], ["x"]]}\nnot json\n')
    assert [tuple(t) for t in readers.subgraph_cache(spark, sub).first().triples] == [("a", "r", "b")]
    kgs = write("k.jsonl", json.dumps({"q": "old", "t": [["a", "r", "b"]]}) + "\n" + json.dumps({"question": "new", "triples": [{"h": "a", "pid": "P1", "r": "r", "t": "b", "score": 0.5, "hop": 1}]}) + "\n")
    assert sorted((r.question, len(r.triples)) for r in readers.question_kg(spark, kgs).collect()) == [("new", 1), ("old", 1)]
    txt = write("m.txt", "em: 0.5\nnote: a: b\n")
    assert [(r.name, r.text, r.number) for r in readers.key_values(spark, txt).collect()] == [("em", "0.5", 0.5), ("note", "a: b", None)]
    write("runs/m1/hotpot/seed_3/2024_a/metric_score.json", '{"em": 0.1}')
    write("runs/m1/hotpot/seed_3/2024_b/metric_score.json", '{"em": 0.2}')
    run = readers.newest_metrics(spark, str(tmp_path / "runs")).first()
    assert (run.method, run.dataset, run.seed, run.metrics) == ("m1", "hotpot", 3, {"em": 0.2})
    preds = write("p.json", '{"data": [{"id": "1", "pred": "x"}]}')
    assert readers.predictions(spark, preds).first().pred == "x"
    log = write("l.txt", "step=5 kl=0.25 loss=-1.5e-3\nnothing\n")
    assert sorted((r.step, r.name, r.value) for r in readers.training_log(spark, log).collect()) == [(5, "kl", 0.25), (5, "loss", -0.0015)]
    assert readers.corpus(spark, write("d.jsonl", '{"id": "1", "text": "t"}\n')).first().contents == "t"
    table = spark.createDataFrame([("a", 1.0)], "name string, x double")
    assert sinks.markdown(table) == "| name | x |\n|---|---|\n| a | 1.0000 |"
    sinks.json_lines(table, str(tmp_path / "out"))
    sinks.json_lines(table, str(tmp_path / "out"), append=True)
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    sinks.manifest(spark, str(tmp_path / "manifest"), {"seed": 1})
    assert json.loads(spark.read.text(str(tmp_path / "manifest")).first().value)["run"] == {"seed": 1}


def test_each_seed_has_its_own_limit(spark):
    edges = spark.createDataFrame([(h, r, f"{h}{i:02d}") for h, r in (("b", "a-first"), ("a", "z-last")) for i in range(40)] + [(f"{h}{i:02d}", "next", "x") for h in "ab" for i in range(40)], "h string, r string, t string")
    seeds = spark.createDataFrame([("q", "b", 1), ("q", "a", 0)], "qid string, seed string, place int")
    one = [(r.pos, r.h, r.t) for r in kg.one_hop(seeds, edges).orderBy("pos").collect()]
    assert one == [(k + 1, h, f"{h}{i:02d}") for k, (h, i) in enumerate((h, i) for h in "ab" for i in range(30))]
    two = kg.two_hop(seeds, edges).orderBy("pos").collect()
    assert [r.pos for r in two] == list(range(1, 121)) and [r.t for r in two if r.t != "x"] == [t for *_, t in one]
    assert kg.merged_hops(seeds, edges).count() == 120
