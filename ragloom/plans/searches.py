"""Searches over many chains of reasoning at once: a tree of rewritten queries, interleaved retrieval, and several sampled chains for a question.

A chain is a row, keyed by ``qid``. Each round is one call of an injected model over all live rows, one search and one join, with lineage cut after it; the numbers of rounds, branches and
chains are parameters, so the rows of a question are bounded. A model step adds ``answer`` to rows with ``qid`` and ``prompt`` (see ``rag.batched``), and ``logprobs`` (array<double>) where it says so.
A search is one over the documents' stored index, made once, unless another is given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragloom.functions import text as X
from ragloom.operators import index as I
from ragloom.operators import retrieval as R
from ragloom.plans.rag import Step, best_path
from ragloom.session import cut

# Marks of the tree's format, and what stands in for a query or an answer that can't be read.
REWRITES = ("[S_Rewritten_Query]", "[S_Decomposed_Query]", "[S_Disambiguated_Query]")
RESPONSE, EVIDENCE, EVIDENCE_END, END = "[A_Response]", "[R_Evidences]", "[/R_Evidences]", "[EOS]"
NO_QUERY, NO_RESPONSE = "dummy", "Unable to detect valid answer"
# Fixed value: the mark of a thought that ends an interleaved chain.
LAST_THOUGHT = "So the answer is:"


def before_end(text: Column, otherwise: str) -> Column:
    """The last part of an output that the end mark closes, trimmed."""
    parts = F.split(text, r"\[EOS\]")
    return F.when(F.size(parts) > 1, X.squeeze_ends(F.element_at(parts, -2))).otherwise(otherwise)


def confidence(logprobs: Column) -> Column:
    """The mean chance of an output's tokens but the first and the last; 0 where none is left."""
    inner = F.slice(logprobs, 2, F.greatest(F.lit(0), F.size(logprobs) - 2))
    mean = F.aggregate(inner, F.lit(0.0), lambda s, x: s + F.exp(x)) / F.size(inner)
    return F.when(F.coalesce(F.size(inner), F.lit(0)) > 0, mean).otherwise(0.0)


def found(docs: DataFrame, search: I.Search, asked: DataFrame, k: int, line: Column) -> DataFrame:
    """``qid`` and ``shown``: the hits of each query (qid, text) in order of rank, each as ``line`` says of ``rank`` and ``text``."""
    hits = R.with_texts(search(asked, k), docs)
    rows = hits.select("qid", F.struct("rank", line.alias("line")).alias("x"))
    return rows.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "").alias("shown"))


def tree_search(docs: DataFrame, queries: DataFrame, generate: Step, depth: int = 3, width: int | None = None, k: int = 5, head: str = "", search: I.Search | None = None, rewrites: Sequence[str] = REWRITES) -> tuple[DataFrame, DataFrame]:
    """A tree of rewritten queries for each question: the best answers (qid, answer, confidence, path) and all nodes (qid, path, parent, depth, query, answer, confidence).

    Every node is asked for an answer, and above ``depth`` for one query of each kind in ``rewrites``, whose passages make a child. ``path`` is a struct of depth and branch numbers, ``parent`` the branch
    numbers without the last one. With ``width`` only so many nodes of a question go on from each level: those that are surest of their own answer, then in order of path. ``generate`` adds ``answer`` and ``logprobs``.
    """
    search = search or I.searcher(docs)
    line = F.concat(F.lit("Title: "), X.title_of(F.col("text")), F.lit("\nText: "), X.body_of(F.col("text")), F.lit("\n"))
    kinds = F.array(*[F.struct(F.lit(i).alias("branch"), F.lit(mark).alias("mark")) for i, mark in enumerate((*rewrites, RESPONSE))])
    own = lambda: F.concat_ws("/", "q", F.array_join("steps", "."))  # noqa: E731; the key of a row of one question and node
    live = queries.select(F.col("qid").alias("q"), F.array().cast("array<int>").alias("steps"), F.lit(None).cast("string").alias("query"), F.concat(F.lit(head), "text").alias("prompt"))
    nodes = None
    for level in range(depth + 1):
        wanted = kinds if level < depth else F.slice(kinds, len(rewrites) + 1, 1)
        asked = live.select("q", "steps", "query", F.col("prompt").alias("so_far"), F.explode(wanted).alias("kind"))
        asked = asked.select(F.concat_ws("/", own(), "kind.branch").alias("qid"), "q", "steps", "query", "kind.branch", F.concat("so_far", "kind.mark").alias("prompt"))
        said = cut(generate(asked))
        answers = said.where(F.col("branch") == len(rewrites))
        answers = answers.select("q", "steps", "query", before_end(F.col("answer"), NO_RESPONSE).alias("answer"), confidence(F.col("logprobs")).alias("confidence"))
        nodes = answers if nodes is None else nodes.unionByName(answers)
        if level == depth:
            break
        going = said.where(F.col("branch") < len(rewrites))
        if width is not None:
            surest = Window.partitionBy("q").orderBy(F.col("confidence").desc(), "steps")
            kept = answers.withColumn("nth", F.row_number().over(surest)).where(F.col("nth") <= width).select("q", "steps")
            going = going.join(kept, ["q", "steps"], "left_semi")
        going = going.withColumn("query", before_end(F.col("answer"), NO_QUERY))
        shown = found(docs, search, going.select("qid", F.col("query").alias("text")), k, line)
        grown = F.concat("prompt", "answer", F.lit(EVIDENCE), F.coalesce("shown", F.lit("")), F.lit(EVIDENCE_END))
        live = cut(going.join(shown, "qid", "left").select("q", F.concat("steps", F.array("branch")).alias("steps"), "query", grown.alias("prompt")))
    path = F.struct(F.size("steps").alias("depth"), "steps")
    parent = F.when(F.size("steps") > 0, F.slice("steps", F.lit(1), F.size("steps") - 1))
    nodes = cut(nodes.select(F.col("q").alias("qid"), path.alias("path"), parent.alias("parent"), F.size("steps").alias("depth"), "query", "answer", "confidence"))
    best = best_path(nodes.select("qid", "path", "answer", F.col("confidence").alias("score"))).withColumnRenamed("score", "confidence")
    return best, nodes


def walked_back(best: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes from the root to each question's best one: qid, depth, query, answer, confidence."""
    prefixes = F.transform(F.sequence(F.lit(0), F.col("path.depth")), lambda n: F.slice(F.col("path.steps"), F.lit(1), n))
    wanted = best.select("qid", F.explode(prefixes).alias("steps"))
    return nodes.withColumn("steps", F.col("path.steps")).join(wanted, ["qid", "steps"]).select("qid", "depth", "query", "answer", "confidence")


def interleaved_thoughts(docs: DataFrame, queries: DataFrame, generate: Step, rounds: int = 2, k: int = 5, lead: str = "", search: I.Search | None = None) -> DataFrame:
    """Retrieve, think one thought, retrieve for the thought, and so on: qid, pred (all thoughts), n_thoughts, docs (ids as last shown).

    A document's score is the best of all rounds, and they are shown from the lowest score to the highest, so the best stands next to the question. A thought with the last mark ends its question.
    """
    search = search or I.searcher(docs)
    line = F.concat(F.lit("Wikipedia Title: "), X.title_of(F.col("text")), F.lit("\n"), X.body_of(F.col("text")), F.lit("\n\n"))
    scores = cut(search(queries.select("qid", "text"), k).select("qid", "doc_id", "score"))
    # The first time they are shown best first, as they come.
    order = F.struct(-F.col("score"), "doc_id")
    active = queries.select("qid", "text", F.array().cast("array<string>").alias("thoughts"))
    out = None
    for n in range(rounds):
        shown = R.with_texts(scores, docs).withColumn("line", line).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(order.alias("place"), "doc_id", "line"))).alias("x"))
        rows = active.join(shown, "qid", "left").withColumn("docs", F.coalesce(F.transform("x", lambda x: x["doc_id"]), F.array().cast("array<bigint>")))
        passages = F.coalesce(F.array_join(F.transform("x", lambda x: x["line"]), ""), F.lit(""))
        prompt = F.concat(F.lit(lead), passages, F.lit("Question: "), "text", F.lit("\nThought:"), F.array_join("thoughts", " "))
        said = cut(generate(rows.select("qid", "text", "thoughts", "docs", prompt.alias("prompt"))).select("qid", "text", "docs", F.concat("thoughts", F.array("answer")).alias("thoughts"), F.coalesce("answer", F.lit("")).alias("last")))
        ended = F.contains("last", F.lit(LAST_THOUGHT))
        going = said.where(~ended)
        new = search(going.select("qid", F.col("last").alias("text")), k).select("qid", "doc_id", "score")
        scores = cut(R.max_merge(scores.unionByName(new)))
        # From now on lowest first; ties by the smaller doc_id.
        order = F.struct("score", "doc_id")
        done = said.where(ended) if n < rounds - 1 else said
        if n == rounds - 1:
            last = scores.join(going.select("qid"), "qid", "left_semi").groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["doc_id"]).alias("now"))
            done = done.join(last, "qid", "left").withColumn("docs", F.coalesce("now", "docs"))
        done = done.select("qid", F.array_join("thoughts", " ").alias("pred"), F.size("thoughts").alias("n_thoughts"), "docs")
        out = done if out is None else out.unionByName(done)
        active = going.select("qid", "text", "thoughts")
    return out


def plain_query(text: Column) -> Column:
    """A generated query without quotes around it and without its lead-in."""
    bare = X.squeeze_ends(text)
    bare = F.when(F.startswith(bare, F.lit('"')) & F.endswith(bare, F.lit('"')) & (F.length(bare) > 1), F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)
    return F.regexp_replace(bare, r"^Intermediate query \d+: ", "")


def chains(docs: DataFrame, queries: DataFrame, generate: Step, n: int = 4, rounds: int = 4, k: int = 5, search: I.Search | None = None) -> DataFrame:
    """``n`` sampled chains of sub-questions for each question: qid, chain, asked, answers (arrays), answer, score.

    In each round a chain asks a sub-question, searches for it and answers it from what was found; after ``rounds`` rounds it gives its final answer from all of them. Chains of a question differ by
    the column ``seed`` alone, which ``generate`` gets beside ``qid`` and ``prompt``; it adds ``answer`` and ``logprobs``, and ``score`` is the mean log-probability of the final answer.
    """
    search = search or I.searcher(docs)
    line = F.concat(F.lit("["), "rank", F.lit("] "), "text", F.lit("\n"))
    pairs = lambda: F.array_join(F.transform(F.arrays_zip("asked", "answers"), lambda x: F.concat(F.lit("\nIntermediate query: "), x["asked"], F.lit("\nIntermediate answer: "), x["answers"])), "")
    empty = F.array().cast("array<string>")
    live = queries.select("qid", "text", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("chain"), empty.alias("asked"), empty.alias("answers"))
    step = lambda rows, prompt: generate(rows.withColumnRenamed("qid", "q").select(F.concat_ws("/", "q", "chain").alias("qid"), "*", F.col("chain").alias("seed"), prompt.alias("prompt")))
    for _ in range(rounds):
        said = cut(step(live, F.concat(F.lit("Main question: "), "text", pairs(), F.lit("\nNext intermediate query:"))).withColumn("query", plain_query(F.col("answer"))))
        shown = found(docs, search, said.select("qid", F.col("query").alias("text")), k, line)
        rows = said.join(shown, "qid", "left").select(F.col("q").alias("qid"), "text", "chain", "asked", "answers", "query", F.coalesce("shown", F.lit("")).alias("shown"))
        told = step(rows, F.concat("shown", F.lit("Intermediate query: "), "query", F.lit("\nIntermediate answer:")))
        live = cut(told.select(F.col("q").alias("qid"), "text", "chain", F.concat("asked", F.array("query")).alias("asked"), F.concat("answers", F.array(X.squeeze_ends(F.col("answer")))).alias("answers")))
    final = step(live, F.concat(F.lit("Main question: "), "text", pairs(), F.lit("\nFinal answer:")))
    mean = F.aggregate("logprobs", F.lit(0.0), lambda s, x: s + x) / F.size("logprobs")
    return final.select(F.col("q").alias("qid"), "chain", "asked", "answers", X.squeeze_ends(F.col("answer")).alias("answer"), F.when(F.size("logprobs") > 0, mean).alias("score"))


def best_of(rollouts: DataFrame, key: Column | None = None) -> DataFrame:
    """The choice among each question's chains: qid, best (the answer of the highest score, then of the first chain), voted (the answer most chains gave, then the one of the highest score), votes, n_chains.

    Votes are counted by ``key`` of an answer (the normalised answer by default).
    """
    key = X.norm_core(F.col("answer")) if key is None else key
    score = F.coalesce("score", F.lit(float("-inf")))
    rows = rollouts.select("qid", "chain", "answer", score.alias("score"), key.alias("key"))
    first = lambda: F.struct((-F.col("score")).alias("score"), "chain")
    votes = rows.groupBy("qid", "key").agg(F.count(F.lit(1)).alias("n"), F.min_by("answer", first()).alias("answer"), F.min(first()).alias("place"))
    top = F.struct((-F.col("n")).alias("n"), "place")
    return votes.groupBy("qid").agg(F.min_by("answer", "place").alias("best"), F.min_by("answer", top).alias("voted"), F.max("n").alias("votes"), F.sum("n").alias("n_chains"))
