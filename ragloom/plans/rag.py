"""Retrieval-augmented pipelines as DataFrame chains.

Model steps are injected functions ``DataFrame -> DataFrame``; ``generate`` gets qid, prompt and adds answer. ``batched`` makes one from a client that is
built once in each task. Loops run a fixed number of rounds, with lineage cut between them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragloom.functions import metrics as M
from ragloom.functions import text as X
from ragloom.operators import index as I
from ragloom.operators import retrieval as R
from ragloom.session import cut

#: Summaries that are sorted in one task.
TASK_ROWS = 1 << 19

Step = Callable[[DataFrame], DataFrame]


def batched(make_client: Callable[[], Callable[[list[str]], list[str]]], column: str = "prompt", out: str = "answer") -> Step:
    """An adapter for a model: ``make_client`` is called in each task and gives a function from prompts to texts."""

    def step(rows: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client = make_client()
            for frame in frames:
                yield frame.assign(**{out: client(frame[column].tolist())})

        return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{out}` string")

    return step


def first_sentence(rows: DataFrame) -> DataFrame:
    """A deterministic stand-in for a generator: the first sentence of the prompt's passage."""
    return rows.withColumn("answer", F.element_at(F.split(X.squeeze_ends(F.regexp_extract("prompt", r"(?s)\nPassage: (.*)$", 1)), X.SENTENCE_END), 1))


def prompts(packed: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, prompt: the question and its packed passages in order."""
    joined = packed.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "packed"))), lambda x: x["packed"]), "\n").alias("passages"))
    return queries.join(joined, "qid", "left").select("qid", F.concat(F.lit("Question: "), "text", F.lit("\nPassage: "), F.coalesce("passages", F.lit(""))).alias("prompt"))


def sequential(docs: DataFrame, queries: DataFrame, generate: Step = first_sentence, k: int = 5, budget: int = 600, search: I.Search | None = None) -> DataFrame:
    """Retrieve, rerank, pack, prompt, generate: qid, answer. Without a ``search`` the texts are read for this one time."""
    found = cut(R.with_texts(search(queries, k) if search else R.bm25(docs, queries, k), docs))
    hits = found.join(queries.withColumnRenamed("text", "query"), "qid")
    order = R.lexical_rerank(hits, k).select("qid", "doc_id", "rank").join(found.select("qid", "doc_id", "text"), ["qid", "doc_id"])
    return generate(prompts(R.pack_budget(order, budget), queries)).select("qid", "answer")


def iterative(docs: DataFrame, queries: DataFrame, generate: Step = first_sentence, rounds: int = 2, done: Column | None = None, k: int = 3, search: I.Search | None = None) -> DataFrame:
    """Rounds of retrieval in which each answer joins the next query; a query leaves when ``done`` holds for its answer. qid, round, answer. All rounds ask one stored index."""
    search = search or I.searcher(docs)
    active, out = queries, None
    for n in range(rounds):
        answered = cut(sequential(docs, active, generate, k, search=search).withColumn("round", F.lit(n)))
        out = answered if out is None else out.unionByName(answered)
        going = answered if done is None else answered.where(~F.coalesce(done, F.lit(False)))
        active = queries.join(going.select("qid", "answer"), "qid").select("qid", F.concat_ws(" ", "text", "answer").alias("text"))
    return out


def pairwise_wins(summaries: DataFrame) -> DataFrame:
    """Every ordered pair of a query's summaries is compared; the one with the higher score gets 1, both 0.5 on a tie: qid, i, wins.

    A row's wins are counted from its place in the order of scores, so no pair is made. There are as many tasks as keep each one's rows bounded.
    """
    rows = summaries.where("qid is not null and i is not null").select("qid", "i", "score")
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + summaries.count() // TASK_ROWS)
    rows, counts, others = rows.repartition(tasks, "qid"), [], []
    for keys in (["qid"], ["qid", "i"]):  # all of the query's rows, and those of the row itself, which it isn't compared with
        own = Window.partitionBy(*keys)
        upto, equal = own.orderBy("score").rangeBetween(Window.unboundedPreceding, 0), own.orderBy("score").rangeBetween(0, 0)
        counts.append(F.count("score").over(upto) - F.count("score").over(equal) / 2)
        others.append(F.count(F.lit(1)).over(own))
    scored = rows.withColumn("a", counts[0]).withColumn("n", others[0]).withColumn("b", counts[1]).withColumn("m", others[1]).where("n > m")
    wins = F.when(F.col("score").isNull(), 0.0).otherwise(F.col("a") - F.col("b"))
    return scored.groupBy("qid", "i").agg(F.sum(wins).alias("wins"))


def critique_score(relevant: Column, irrelevant: Column, full: Column, partial: Column, none: Column, utility: list[Column], weights: tuple[float, float, float] = (1.0, 1.0, 0.5)) -> Column:
    """Relevance share, support (a half for partial) and utility (weights from -1 to 1), each normalised, summed."""
    rel = relevant / (relevant + irrelevant)
    support = (full + 0.5 * partial) / (full + partial + none)
    values = (-1.0, -0.5, 0.0, 0.5, 1.0)
    whole = sum(utility[1:], utility[0])
    use = sum((F.lit(v) * u / whole for v, u in list(zip(values, utility))[1:]), F.lit(values[0]) * utility[0] / whole)
    return F.lit(weights[0]) * rel + F.lit(weights[1]) * support + F.lit(weights[2]) * use


def needs_retrieval(yes: Column, no: Column, threshold: float) -> Column:
    return yes / (yes + no) > threshold


def confident(tokens: Column, probs: Column, threshold: float) -> Column:
    """(all confident, the confident tokens): what is kept of a sentence as the next query where some token is not."""
    pairs = F.arrays_zip(tokens.alias("t"), probs.alias("p"))
    kept = F.transform(F.filter(pairs, lambda x: x["p"] > threshold), lambda x: x["t"])
    return F.struct(F.forall(probs, lambda p: p > threshold).alias("all"), F.array_join(kept, " ").alias("query"))


def best_path(paths: DataFrame) -> DataFrame:
    """The path with the highest score of each query."""
    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), "path")
    return paths.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")


def keep_ratio(tokens: DataFrame, ratio: float, sentinel: float = 10_000.0) -> DataFrame:
    """Tokens over the value at sorted position int(n * ratio) - 1 of their text, sentinels aside: key, i, value."""
    real = tokens.where(F.col("value") != sentinel)
    place = real.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(F.col("value").desc(), "i"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key")))
    cutoff = place.where(F.col("nth") == F.greatest(F.lit(1), F.floor(F.col("n") * ratio))).select("key", F.col("value").alias("cutoff"))
    return real.join(cutoff, "key").where("value >= cutoff").select("key", "i", "value")


def evaluated(answers: DataFrame, golds: DataFrame) -> DataFrame:
    """Corpus means of EM, F1 and containment of answers (qid, answer) against golds (qid, golden_answers)."""
    rows = golds.join(answers, "qid", "left").withColumn("pred", F.coalesce("answer", F.lit("")))
    return M.evaluate(rows, ["em", "f1", "acc"])
