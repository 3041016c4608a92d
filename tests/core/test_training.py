"""Training tables and agent loops against plain Python."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from ragloom.functions import metrics
from ragloom.functions.fuzzy import token_sort_ratio
from ragloom.operators import curate, kg, retrieval, training
from ragloom.operators import kg_tables as T
from ragloom.plans import agents


def test_severed_answers(spark):
    graph = [("q1", "Berlin", "capital of", "Germany"), ("q1", "Ulm", "country", "Germany"), ("q1", "x", "y", "german"), ("q2", "Berlin", "in", "Germany"), ("q3", "a", "b", "c")]
    answers = {"q1": " GERMANY ", "q2": "France", "q4": "z"}
    df = spark.createDataFrame(graph, "qid string, h string, r string, t string")
    rows = training.severed_answers(df, spark.createDataFrame(list(answers.items()), "qid string, answer string")).collect()
    near = lambda q, x: q in answers and token_sort_ratio(x.lower(), answers[q].strip().lower()) >= 70
    wanted = sorted((q, near(q, h) or near(q, t)) for q, h, _, t in graph)
    assert sorted((r.qid, r.severed) for r in rows) == wanted
    assert all((r.h in T.NOISE_ENTITIES and r.r in T.NOISE_RELATIONS) if r.severed else (r.qid, r.h, r.r, r.t) in graph for r in rows)


def plain_units(tokens, units):
    """Token by token, with the ends of the units known."""
    ends, at = [], 0
    for u in units:
        at += len(u)
        ends.append(at)
    given, at = [[] for _ in units], 0
    for token, value in tokens:
        start, at = at, at + len(token)
        done = [i for i, e in enumerate(ends) if start < e <= at]
        if done:
            for i in done:
                given[i].append(value / len(done))
        elif token != " ":
            given[next(i for i, e in enumerate(ends) if e > start)].append(value)
    return [sum(g) / len(g) if g else None for g in given]


def test_unit_information(spark):
    rng = random.Random(5)
    tokens, units, wanted = [], [], {}
    for key in range(30):
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 40)))

        def pieces(most):
            out, i = [], 0
            while i < len(text):
                n = rng.randint(1, most)
                out.append(text[i : i + n])
                i += n
            return out

        own, parts = [(t, rng.random()) for t in pieces(4)], pieces(7)
        tokens += [(key, i, t, v) for i, (t, v) in enumerate(own)]
        units += [(key, u, p) for u, p in enumerate(parts)]
        wanted |= {(key, u): v for u, v in enumerate(plain_units(own, parts))}
    got = training.unit_information(spark.createDataFrame(tokens, "key int, i int, token string, value double"), spark.createDataFrame(units, "key int, u int, unit string"))
    found = {(r.key, r.u): r.value for r in got.collect()}
    assert found.keys() == wanted.keys()
    assert all((found[k] is None) == (v is None) and (v is None or abs(found[k] - v) < 1e-9) for k, v in wanted.items())


def test_values_written_back_and_exemplars(spark):
    traces = spark.createDataFrame([("a", ["x", "y", "z"]), ("b", []), ("c", ["x"])], "key string, steps array<string>")
    values = spark.createDataFrame([("a", 2, 0.5), ("a", 0, 1.5), ("d", 0, 9.0)], "key string, step int, value double")
    got = {r.key: r.logprob for r in training.written_back(traces, values, "key", "steps", "logprob").collect()}
    assert got == {"a": [1.5, None, 0.5], "b": [], "c": [None]}
    examples = spark.createDataFrame([(1, [1.0, 0.0], "one"), (2, [0.0, 1.0], "two"), (3, [0.9, 0.2], "three")], "doc_id long, v array<double>, text string")
    items = spark.createDataFrame([("q", [1.0, 0.1]), ("p", [0.0, 2.0])], "qid string, v array<double>")
    assert {r.qid: r.exemplars for r in training.exemplars(items, examples, 2).collect()} == {"q": ["one", "three"], "p": ["two", "three"]}


def test_gold_and_accepted(spark):
    rows = spark.createDataFrame([(1, ["a"], "A!", True), (2, ["a"], None, None), (3, [" "], "b", False), (4, None, "b", True), (5, ["a", "b"], "c", True)], "id int, golden_answers array<string>, pred string, accepted boolean")
    assert sorted(r.id for r in training.hard_examples(rows).collect()) == [2, 5]
    assert sorted(r.id for r in training.accepted(rows).collect()) == [1, 4, 5]


def test_two_hop_limits_equal_full_join(spark):
    rng = random.Random(2)
    edges = sorted({(f"n{rng.randint(0, 8)}", f"r{rng.randint(0, 3)}", f"n{rng.randint(0, 8)}") for _ in range(120)}) + [("n0", "r9", "leaf"), ("n0", "a", "leaf")]
    seeds = [("q", "n0"), ("q", "n1"), ("p", "n0")]
    got = kg.two_hop(spark.createDataFrame(seeds, "qid string, seed string"), spark.createDataFrame(edges, "h string, r string, t string"), 5).collect()
    wanted = []
    for q in ("q", "p"):
        n = 0
        for _, seed in sorted(s for s in seeds if s[0] == q):
            paths = sorted((r, t, r2, t2) for h, r, t in edges if h == seed for h2, r2, t2 in edges if h2 == t)[:5]
            for r, t, r2, t2 in paths:
                n += 1
                wanted += [(q, 2, 2 * n - 1, seed, r, t), (q, 2, 2 * n, t, r2, t2)]
    assert sorted(tuple(r) for r in got) == sorted(wanted)


def test_quota_keeps_null_streams(spark):
    rows = [(None, i, "kg_rich" if i % 2 else "kg_sparse") for i in range(6)] + [("s", i, None) for i in range(3)]
    got = curate.stratified_quota(spark.createDataFrame(rows, "s string, i long, bucket string"), "s", "i").collect()
    assert sorted((r.i, r.accepted) for r in got if r.s is None) == [(0, True), (1, True), (2, False), (3, True), (4, False), (5, True)]
    assert [r.accepted for r in got if r.s == "s"] == [False] * 3


def test_bm25_counts_every_document(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, ""), (3, None), (4, "blue whale red red")], "doc_id long, text string")
    p = retrieval.postings(docs, spark.createDataFrame([("q", "red")], "qid string, text string"))
    whole = p.whole.first()
    assert whole.n == 4 and abs(whole.avgdl - 2.0) < 1e-12
    assert sorted((r.term, r.doc_id, r.tf) for r in p.posts.collect()) == [("red", 1, 1), ("red", 4, 2)]


def test_reasoning_ends(spark):
    docs = spark.createDataFrame([(1, "7 paris is in france"), (2, "rome is in italy")], "doc_id long, text string")
    asked = spark.createDataFrame([("a", "paris"), ("b", "plain"), ("c", "broken"), ("d", "loops"), ("e", "tagged")], "qid string, text string")

    def model(rows):
        search = F.lit(f"look {agents.QUERY} paris {agents.QUERY_END}")
        out = F.when(F.startswith("prompt", F.lit("plain")), " just so ").when(F.startswith("prompt", F.lit("broken")), f"{agents.QUERY_END}{agents.QUERY} x {agents.QUERY_END}")
        out = out.when(F.startswith("prompt", F.lit("tagged")), "<answer> now </answer>").when(F.startswith("prompt", F.lit("loops")), search)
        done = F.concat(F.lit("<answer>"), F.regexp_extract("prompt", r"\(1\)(\S+)", 1), F.lit("</answer>"))
        return rows.withColumn("answer", out.when(F.contains("prompt", F.lit(agents.DOCS)), done).otherwise(search))

    got = {r.qid: (r.pred, r.reason, r.n_searches) for r in agents.reasoning(docs, asked, model, rounds=2, k=1).collect()}
    assert got["a"] == ("paris", "Finished", 1) and got["e"] == ("now", "Finished", 0)
    assert got["b"] == ("just so", "Normal finish without answer pattern", 0)
    assert got["d"] == (agents.NO_ANSWER, "Reach max retrieval number", 2) and len(got) == 5


def test_self_ask(spark):
    docs = spark.createDataFrame([(1, "paris is in france"), (2, "rome is in italy")], "doc_id long, text string")
    asked = spark.createDataFrame([("a", "where is paris"), ("b", "silence")], "qid string, text string")

    def model(rows):
        final = F.lit("So the final answer is: Italy\n")
        return rows.withColumn("answer", F.when(F.contains("prompt", F.lit("silence")), "").when(F.contains("prompt", F.lit("Follow up: rome")), final).otherwise("Follow up: rome\nIntermediate answer: none"))

    got = {r.qid: (r.pred, r.n_rounds) for r in agents.self_ask(docs, asked, model, rounds=4, k=1).collect()}
    assert got["b"] == ("", 1) and got["a"][1] == 2
    assert re.fullmatch(r"Context1: rome is in italy\n\nQuestion: where is paris\nAre follow up questions needed here: No\.\nFollow up: romeSo the final answer is: Italy", got["a"][0])


def test_bleu_of_four_words(spark):
    pairs = [("The cat, it sat on 3.5 mats - all of it!", "The cat sat on 3.5 mats; all of it!"), ("a b c d e", "a b c d e f"), ("x", "y z")]

    def tokens(text):
        out = f" {text} "
        for pattern, put in ((r"([{-~\[-` -&(-+:-@/])", r" \1 "), (r"([^0-9])([.,])", r"\1 \2 "), (r"([.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
            out = re.sub(pattern, put, out)
        return out.split()

    match, total, lengths = [0] * 4, [0] * 4, [0, 0]
    for p, g in ((tokens(p), tokens(g)) for p, g in pairs):
        lengths = [lengths[0] + len(p), lengths[1] + len(g)]
        for n in range(1, 5):
            grams = [Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (p, g)]
            match[n - 1] += sum((grams[0] & grams[1]).values())
            total[n - 1] += sum(grams[0].values())
    wanted = math.exp(sum(math.log(m / t) for m, t in zip(match, total)) / 4) * min(1.0, math.exp(1 - lengths[1] / lengths[0]))
    row = metrics.bleu(spark.createDataFrame(pairs, "pred string, gold string")).first()
    assert abs(row.bleu - wanted) < 1e-9 and abs(row.p4 - match[3] / total[3]) < 1e-9


def test_samples_keep_columns_of_any_name(spark):
    rows = spark.createDataFrame([(i, i * 10, "h", 0) for i in range(20)], "id long, sample_rank long, sample_hash string, sample_group int")
    got = curate.hash_sample(rows, "id", F.lit(5)).collect()
    assert len(got) == 5 and all(r.sample_rank == r.id * 10 and r.sample_hash == "h" and r.sample_group == 0 for r in got)
