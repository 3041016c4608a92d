"""Agent loops over all questions at once: each round is one call of an injected model, one search and one join; finished questions leave.

A model is a function that adds ``answer`` to rows with ``qid`` and ``prompt`` (see ``rag.batched``). A search is one over the documents' stored index, made once for all rounds, unless another is given.
Lineage is cut after each round, and the number of rounds is fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions import text as X
from ragloom.operators import index as I
from ragloom.operators import retrieval as R
from ragloom.plans.rag import Step
from ragloom.session import cut

# The marks of the reasoning format, and what a question without an answer gets.
QUERY, QUERY_END, DOCS, DOCS_END = "<|begin_of_query|>", "<|end_of_query|>", "<|begin_of_documents|>", "<|end_of_documents|>"
ANSWER, ANSWER_END, TEXT_END = "<answer>", "</answer>", "<|endoftext|>"
NO_ANSWER = "No valid answer found"
FOLLOW_UP, INTERMEDIATE, FINAL = "Follow up: ", "Intermediate answer:", "So the final answer is: "


def between(text: Column, start: str, stop: str) -> Column:
    """What stands between the first ``start`` and the next ``stop``, trimmed; null without both."""
    rest = F.when(F.contains(text, F.lit(start)), F.substring(text, F.instr(text, start) + len(start), F.length(text)))
    return F.when(F.contains(rest, F.lit(stop)), X.squeeze_ends(F.substring_index(rest, stop, 1)))


def _found(docs: DataFrame, search: I.Search, asked: DataFrame, k: int, numbered: Column) -> DataFrame:
    """``qid`` and ``shown``: the hits of each query (qid, text) in order of rank, each as ``numbered`` says of ``rank`` and ``text``."""
    hits = R.with_texts(search(asked, k), docs)
    rows = hits.select("qid", F.struct("rank", numbered.alias("line")).alias("x"))
    return rows.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "").alias("shown"))


def reasoning(docs: DataFrame, queries: DataFrame, generate: Step, rounds: int = 5, k: int = 5, search: I.Search | None = None) -> DataFrame:
    """Think, search, read, think on: qid, pred, reason, n_searches.

    An output that ends in an answer finishes its question; one that ends in a query is searched, and what was found joins the prompt; any other is the prediction itself.
    A query that can't be read, and ``rounds`` rounds without an end, leave a question without an answer.
    """
    search = search or I.searcher(docs)
    line = F.concat(F.lit("("), F.col("rank"), F.lit(")"), F.regexp_replace(F.col("text"), r"^\d+\s+", ""), F.lit("\n"))
    active = queries.select("qid", F.col("text").alias("prompt"), F.lit(0).alias("n_searches"))
    out = None
    for _ in range(rounds):
        said = generate(active)
        ended = (F.endswith("answer", F.lit(ANSWER_END)) | F.endswith("answer", F.lit(TEXT_END))) & F.contains("answer", F.lit(ANSWER_END))
        asks = F.endswith("answer", F.lit(QUERY_END)) & F.contains("answer", F.lit(QUERY))
        query = F.when(asks, between(F.col("answer"), QUERY, QUERY_END))
        answered = F.coalesce(between(F.col("answer"), ANSWER, ANSWER_END), F.lit(NO_ANSWER))
        pred = F.when(ended, answered).when(asks & query.isNull(), NO_ANSWER).when(query.isNull(), X.squeeze_ends(F.coalesce("answer", F.lit(""))))
        reason = F.when(ended, "Finished").when(asks, "Query instruction error").otherwise("Normal finish without answer pattern")
        said = cut(said.select("qid", F.concat("prompt", X.squeeze_ends(F.col("answer"))).alias("prompt"), "n_searches", pred.alias("pred"), reason.alias("reason"), query.alias("query")))
        done = said.where("pred is not null").select("qid", "pred", "reason", "n_searches")
        out = done if out is None else out.unionByName(done)
        going = said.where("pred is null")
        seen = F.concat(F.lit(f"\n\n{DOCS}\n"), F.coalesce("shown", F.lit("")), F.lit(f"\n{DOCS_END}\n\n"))
        shown = _found(docs, search, going.select("qid", F.col("query").alias("text")), k, line)
        active = cut(going.join(shown, "qid", "left").select("qid", F.concat("prompt", seen).alias("prompt"), (F.col("n_searches") + 1).alias("n_searches")))
    left = active.select("qid", F.lit(NO_ANSWER).alias("pred"), F.lit("Reach max retrieval number").alias("reason"), "n_searches")
    return left if out is None else out.unionByName(left)


def self_ask(docs: DataFrame, queries: DataFrame, generate: Step, rounds: int = 5, k: int = 5, lead: str = "", single_hop: bool = True, search: I.Search | None = None) -> DataFrame:
    """Follow-up questions until the final answer: qid, pred (the whole dialogue), n_rounds.

    Outputs are read in turn: up to an intermediate answer, then up to and with the first follow-up, and so on. A follow-up replaces the passages by those found for it.
    A question leaves with its final answer, or when nothing was said.
    """
    search = search or I.searcher(docs)
    line = F.concat(F.lit("Context"), F.col("rank"), F.lit(": "), F.col("text"), F.lit("\n"))
    head = lambda shown, text: F.concat(shown, F.lit("\nQuestion: "), text, F.lit(f"\nAre follow up questions needed here: {'No.' if single_hop else 'Yes.'}\n"))
    first = _found(docs, search, queries.select("qid", "text"), k, line)
    active = cut(queries.join(first, "qid", "left").select("qid", "text", F.coalesce("shown", F.lit("")).alias("shown"), F.lit("").alias("said")))
    out = None
    for n in range(rounds):
        answered = generate(active.withColumn("prompt", F.concat(F.lit(f"{lead}\n"), head(F.col("shown"), F.col("text")), F.col("said"))))
        if n % 2 == 0:
            part = F.substring_index("answer", INTERMEDIATE, 1)
        else:
            pattern = r"Follow up:[^\n]*\n"
            part = F.concat(F.get(F.split("answer", pattern, 2), F.lit(0)), F.regexp_extract("answer", f"({pattern})", 1))
        said = F.concat("said", part)
        asked = F.get(F.filter(F.split("answer", "\n"), lambda x: F.contains(x, F.lit(FOLLOW_UP))), F.lit(0))
        rows = cut(answered.select(
            "qid", "text", "shown", F.regexp_replace(said, r"\n\z", "").alias("said"), F.substring_index(asked, FOLLOW_UP, -1).alias("query"),
            ((said == "") | F.contains("answer", F.lit(FINAL)) | F.lit(n == rounds - 1)).alias("done"), (said == "").alias("silent"),
        ))
        new = _found(docs, search, rows.where("query is not null and not silent").select("qid", F.col("query").alias("text")), k, line).withColumnRenamed("shown", "new")
        rows = cut(rows.join(new, "qid", "left").withColumn("shown", F.coalesce("new", "shown")))
        done = rows.where("done").select("qid", F.when(F.col("silent"), F.col("said")).otherwise(F.concat(head(F.col("shown"), F.col("text")), "said")).alias("pred"), F.lit(n + 1).alias("n_rounds"))
        out = done if out is None else out.unionByName(done)
        active = rows.where("not done").select("qid", "text", "shown", "said")
    return out
