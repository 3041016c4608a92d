"""Searches over many chains against plain recursive or sequential versions, with the models of the queries written in Python."""

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ragloom.plans import search_queries as Q
from ragloom.plans import searches

DOCS = {i: f"Title {i}\nThe text of number {i} says w{i * 7 % 13} and v{i * 5 % 11}\nmore of it" for i in range(17)}
ASKED = {1: "who wrote the first book", 2: "which river is longest", 5: "w3 v4"}


def hits(text, k):
    h = zlib.crc32(text.encode())
    return [((h + 5 * r) % len(DOCS), r + 1, 1.0 / (1 + (h + r) % 9)) for r in range(k)]


def spark_search(asked, k):
    h = F.crc32(F.encode("text", "utf-8"))
    rows = asked.select("qid", h.alias("h"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("r"))
    return rows.select("qid", ((F.col("h") + 5 * F.col("r")) % len(DOCS)).alias("doc_id"), (F.col("r") + 1).alias("rank"), (1.0 / (1 + (F.col("h") + F.col("r")) % 9)).alias("score"))


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(list(DOCS.items()), "doc_id long, text string"), spark.createDataFrame(list(ASKED.items()), "qid long, text string")


def word(text, n):
    words = text.strip().split()
    return words[n % len(words)]


def rewriting(prompt):
    h = zlib.crc32(prompt.encode())
    if prompt.endswith(searches.RESPONSE):
        answer = " " + word(prompt, h // 11) + "[EOS]"
    else:
        answer = f"{word(prompt, h)} {word(prompt, h // 7)} {word(prompt, 1)}[EOS]"
    sure = math.log((h % 100 + 1) / 101)
    return answer, (math.exp(sure) + math.exp(sure / 2)) / 2


def tree(prompt, query, steps, depth, k, out):
    answer, sure = rewriting(prompt + "[A_Response]")
    out.append((steps, query, answer[:-5].strip(), sure))
    if len(steps) < depth:
        for branch, mark in enumerate(searches.REWRITES):
            said, _ = rewriting(prompt + mark)
            new = said[:-5].strip()
            shown = "".join("Title: {}\nText: {}\n".format(*DOCS[i].split("\n", 1)) for i, *_ in hits(new, k))
            tree(f"{prompt}{mark}{said}[R_Evidences]{shown}[/R_Evidences]", new, (*steps, branch), depth, k, out)


def test_tree_search_equals_recursion(spark, tables):
    best, nodes = searches.tree_search(*tables, Q.rewriting_model, depth=2, k=2, head="Q: ", search=spark_search)
    got = {}
    for r in nodes.collect():
        got.setdefault(r.qid, {})[tuple(r.path.steps)] = (r.query, r.answer, pytest.approx(r.confidence))
        assert r.parent == (r.path.steps[:-1] if r.path.steps else None)
    best = {r.qid: r for r in best.collect()}
    trails = {}
    for r in searches.walked_back(*searches.tree_search(*tables, Q.rewriting_model, depth=2, k=2, head="Q: ", search=spark_search)).collect():
        trails.setdefault(r.qid, {})[r.depth] = r.query
    for q, text in ASKED.items():
        out = []
        tree("Q: " + text, None, (), 2, 2, out)
        assert got[q] == {s: (query, a, c) for s, query, a, c in out} and len(out) == 13
        wanted = min(out, key=lambda n: (-n[3], len(n[0]), n[0]))
        assert (tuple(best[q].path.steps), best[q].answer) == (wanted[0], wanted[2]) and best[q].confidence == pytest.approx(wanted[3])
        query = {s: x for s, x, *_ in out}
        assert trails[q] == {n: query[wanted[0][:n]] for n in range(len(wanted[0]) + 1)}


def test_width_keeps_the_surest_of_a_level(spark, tables):
    _, whole = searches.tree_search(*tables, Q.rewriting_model, depth=2, k=2, search=spark_search)
    _, narrow = searches.tree_search(*tables, Q.rewriting_model, depth=2, width=1, k=2, search=spark_search)
    sure = {(r.qid, tuple(r.path.steps)): r.confidence for r in whole.collect()}
    for q in ASKED:
        first = [s for i, s in sure if i == q and len(s) == 1]
        kept = min(first, key=lambda s: (-sure[q, s], s))
        assert {tuple(r.path.steps) for r in narrow.where(F.col("qid") == q).collect()} == {(), *first, *((*kept, b) for b in range(3))}


def test_outputs_that_cannot_be_read(spark, tables):
    silent = lambda rows: rows.withColumn("answer", F.lit("no end")).withColumn("logprobs", F.array(F.lit(-1.0), F.lit(-1.0)))
    best, nodes = searches.tree_search(*tables, silent, depth=1, k=1, search=spark_search)
    assert {(r.answer, r.confidence, r.path.depth) for r in best.collect()} == {("Unable to detect valid answer", 0.0, 0)}
    assert {r.query for r in nodes.where("depth = 1").collect()} == {"dummy"}


def thinking(prompt):
    h = zlib.crc32(prompt.encode())
    thought = f"{word(prompt, h)} {word(prompt, h // 7)}."
    return f"So the answer is: {thought}" if h % 3 == 0 else thought


@pytest.mark.parametrize("rounds", [1, 3])
def test_interleaved_thoughts_equal_a_loop(spark, tables, rounds):
    got = {r.qid: (r.pred, r.n_thoughts, r.docs) for r in searches.interleaved_thoughts(*tables, Q.thinking_model, rounds=rounds, k=3, search=spark_search).collect()}
    for q, text in ASKED.items():
        score, thoughts = {}, []
        for i, _, s in hits(text, 3):
            score[i] = s
        docs = sorted(score, key=lambda i: (-score[i], i))
        for _ in range(rounds):
            shown = "".join("Wikipedia Title: {}\n{}\n\n".format(*DOCS[i].split("\n", 1)) for i in docs)
            thoughts.append(thinking(f"{shown}Question: {text}\nThought:{' '.join(thoughts)}"))
            if searches.LAST_THOUGHT in thoughts[-1]:
                break
            for i, _, s in hits(thoughts[-1], 3):
                score[i] = max(score.get(i, 0), s)
            docs = sorted(score, key=lambda i: (score[i], i))
        assert got[q] == (" ".join(thoughts), len(thoughts), docs)


def sampling(prompt, seed):
    h = zlib.crc32(f"{prompt}/{seed}".encode())
    said = word(prompt, h % 3 + 2) if prompt.endswith("Final answer:") else f'"{word(prompt, h)} {word(prompt, h // 7)}"'
    return said, (-(h % 50) / 10 - (h % 7) / 10) / 2


def unquoted(text):
    return re.sub(r"^Intermediate query \d+: ", "", text.strip()[1:-1])


def test_chains_and_their_choice_equal_loops(spark, tables):
    found = searches.chains(*tables, Q.sampling_model, n=5, rounds=2, k=2, search=spark_search)
    got = {(r.qid, r.chain): (r.asked, r.answers, r.answer, pytest.approx(r.score)) for r in found.collect()}
    choice = {r.qid: r for r in searches.best_of(found).collect()}
    for q, text in ASKED.items():
        rows = []
        for c in range(5):
            asked, answers = [], []
            pairs = lambda: "".join(f"\nIntermediate query: {a}\nIntermediate answer: {b}" for a, b in zip(asked, answers))  # noqa: B023, E731
            for _ in range(2):
                query = unquoted(sampling(f"Main question: {text}{pairs()}\nNext intermediate query:", c)[0])
                shown = "".join(f"[{r}] {DOCS[i]}\n" for i, r, _ in hits(query, 2))
                told = sampling(f"{shown}Intermediate query: {query}\nIntermediate answer:", c)[0]
                asked.append(query)
                answers.append(told)
            answer, score = sampling(f"Main question: {text}{pairs()}\nFinal answer:", c)
            rows.append((answer, score))
            assert got[q, c] == (asked, answers, answer, score)
        best = min(range(5), key=lambda c: (-rows[c][1], c))
        votes = Counter(a for a, _ in rows)
        top = min(range(5), key=lambda c: (-votes[rows[c][0]], -rows[c][1], c))
        assert (choice[q].best, choice[q].votes, choice[q].n_chains) == (rows[best][0], max(votes.values()), 5)
        assert choice[q].voted == rows[top][0]
    assert len({tuple(x[0]) for (q, _), x in got.items() if q == 1}) > 1  # chains differ by seed


def test_pairwise_wins_make_no_pairs(spark):
    from ragloom.plans import rag

    nan = float("nan")
    rows = [(1, 1, 5.0), (1, 2, 5.0), (1, 3, 2.0), (1, 4, None), (1, 5, nan), (1, 1, 1.0), (1, None, 9.0), (2, 1, 3.0), (None, 1, 1.0), (None, 2, 1.0), (3, 7, 0.0), (3, 8, -0.0)]
    got = rag.pairwise_wins(spark.createDataFrame(rows, "qid long, i long, score double"))
    place = lambda x: -1 if x is None else float("inf") if x != x else x
    wanted = {}
    for q, i, x in rows:
        for p, j, y in rows:
            if None not in (q, i, j) and q == p and i != j:
                point = 0.0 if x is None or y is None else 1.0 if place(x) > place(y) else 0.5 if place(x) == place(y) else 0.0
                wanted[q, i] = wanted.get((q, i), 0.0) + point
    assert {(r.qid, r.i): r.wins for r in got.collect()} == wanted
    many = rag.pairwise_wins(spark.range(20000).selectExpr("1 as qid", "id as i", "double(id) as score"))
    assert "Join" not in many._jdf.queryExecution().optimizedPlan().toString()
    assert many.where("wins = i").count() == 20000


def test_tasks_of_pairwise_wins_grow_with_the_rows(spark, monkeypatch):
    from ragloom.plans import rag

    monkeypatch.setattr(rag, "TASK_ROWS", 100)
    assert rag.pairwise_wins(spark.range(5000).selectExpr("id div 5 as qid", "id as i", "double(id) as score")).rdd.getNumPartitions() == 51
