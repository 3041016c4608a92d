"""Rules on reasoning traces: validity, relevance of citations, rendering, prompts, and labels of steps from their text.

A trace is an array of steps (index, body), as ``functions.text.steps`` gives it, or a table with a row for each step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragloom.functions import text as X
from ragloom.functions.fuzzy import token_sort
from ragloom.operators import reward as R

# Words without content, labels of a step's sections, mentions that are scaffold.
STOP_WORDS = (
    "the a an of in on at to for and or is are was were be been being that this these those which who whom whose what when where why how from with as by into over"
).split()
KNOWLEDGE, CONCLUSION, REASONING, ANSWER = "Knowledge Used:", "Conclusion:", "Reasoning:", "Final Answer:"
SCAFFOLD = (
    "reasoning conclusion therefore thus hence so step final answer knowledge used question steps given evidence passage passages retrieved fact facts triple triples context note "
    "observation observe first second third fourth fifth next then finally also however"
).split()


def bare(text: Column) -> Column:
    """Lower case without ASCII punctuation."""
    return F.regexp_replace(F.lower(text), X.PUNCTUATION, "")


def phrase_in(phrase: Column, text: Column) -> Column:
    """Whether ``text`` holds ``phrase`` between word boundaries, punctuation and case aside; an empty phrase is in none."""
    p = X.squeeze_ends(bare(phrase))
    return F.coalesce((p != "") & F.rlike(bare(text), F.concat(F.lit(r"(?U)\b\Q"), p, F.lit(r"\E\b"))), F.lit(False))


def content_tokens(text: Column) -> Column:
    """Distinct words of three letters or more that aren't stop words."""
    return F.array_distinct(F.filter(X.words(bare(text)), lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS)))


def triple_relevant(h: Column, r: Column, t: Column, reasoning: Column, conclusion: Column) -> Column:
    """Whether a part of the triple is in the reasoning or the conclusion; true where both are empty."""
    given = lambda c: F.when(c != "", c)
    text = F.concat_ws(" ", given(reasoning), given(conclusion))
    return (text == "") | phrase_in(h, text) | phrase_in(t, text) | phrase_in(r, text)


def reasoning_of(body: Column) -> Column:
    """A step's text up to its citations, which don't count as evidence for themselves."""
    return F.substring_index(body, KNOWLEDGE, 1)


def conclusion_of(body: Column) -> Column:
    """What follows the conclusion's label, up to the next line; empty without one."""
    return X.squeeze_ends(F.regexp_extract(body, rf"{CONCLUSION}[ \t]*([^\n]*)", 1))


def is_valid(steps: Column, answer: Column, least_steps: int = 3, least_chars: int = 20) -> Column:
    """A trace with enough steps, numbered from 1 without a gap, none empty, with an answer, and with enough text after each label of reasoning."""

    def thought(body: Column) -> Column:
        after = F.substring(body, F.instr(body, REASONING) + len(REASONING), F.length(body))
        return X.squeeze_ends(F.element_at(F.split(after, f"{KNOWLEDGE}|{CONCLUSION}|{ANSWER}"), 1))

    numbered = F.transform(steps, lambda s: s["index"].cast("int")) == F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(steps)))
    full = F.forall(steps, lambda s: (X.squeeze_ends(s["body"]) != "") & (~F.contains(s["body"], F.lit(REASONING)) | (F.length(thought(s["body"])) >= least_chars)))
    return F.coalesce((F.size(steps) >= least_steps) & answer.isNotNull() & numbered & full, F.lit(False))


def needs_retry(n_steps: Column, n_cited: Column, n_graph: Column, least_steps: int) -> Column:
    """Too few steps, or a graph to cite from and no citation."""
    return (n_steps < least_steps) | ((n_graph > 0) & (n_cited == 0))


def capped(steps: Column, most: int) -> Column:
    """The first ``most`` steps of a trace."""
    return F.slice(steps, 1, most)


def rendered(steps: Column, answer: Column) -> Column:
    """Steps (label, body) as text, those labelled -1 left out and the others numbered anew, then the answer if there is one."""
    kept = F.filter(steps, lambda s: F.coalesce(s["label"] != -1, F.lit(True)))
    parts = F.transform(kept, lambda s, i: F.concat(F.lit("[Step "), (i + 1).cast("string"), F.lit("]\n"), X.squeeze_ends(s["body"])))
    last = F.coalesce(X.squeeze_ends(answer), F.lit(""))
    return F.array_join(F.concat(parts, F.when(last != "", F.array(F.concat(F.lit("[Final Answer]\n"), last))).otherwise(F.expr("cast(array() as array<string>)"))), "\n\n")


def prefix_prompts(prompt: Column, bodies: Column) -> Column:
    """For each step the prompt with all earlier steps."""
    return F.transform(bodies, lambda _, i: F.array_join(F.concat(F.array(prompt), F.slice(bodies, F.lit(1), i)), "\n"))


def label_class(label: Column) -> Column:
    """-1, 0, 1 as 0, 1, 2; anything else as 1."""
    return F.coalesce(F.when(label.isin(-1, 0, 1), label.cast("int") + 1), F.lit(1))


def triple_text(h: Column, r: Column, t: Column) -> Column:
    return F.concat(F.lit("<"), h, F.lit("; "), r, F.lit("; "), t, F.lit(">"))


def chosen_texts(choices: Column, indexes: Column) -> Column:
    """The texts of the choices at the given places, from 0."""
    return F.transform(indexes, lambda i: F.get(choices, i))


def clean_entities(entities: Column) -> Column:
    """Mentions trimmed, each once in order, without empty ones and scaffold words."""
    return F.array_distinct(F.filter(F.transform(entities, X.squeeze_ends), lambda e: (e != "") & ~F.lower(e).isin(*SCAFFOLD)))


def robust_mentions(named: Column, question: Column, titles: Column, most: int = 8, n_titles: int = 5) -> Column:
    """Mentions from a recogniser, the question's capitalised phrases and the titles of the first passages, each once in that order."""
    none = F.expr("cast(array() as array<string>)")
    return F.slice(clean_entities(F.concat(F.coalesce(named, none), X.mentions(question), F.slice(F.coalesce(titles, none), 1, n_titles))), 1, most)


def verified_citations(cited: DataFrame, graph: DataFrame, cutoff: float = 80.0) -> DataFrame:
    """``cited`` (qid, h, r, t) with ``verified``: whether a triple of the question's graph has all three parts at a ratio of ``cutoff`` or more.

    Equal triples are found by a join on all parts; only the others are compared with the triples of their question, which are as many as were kept for it.
    """
    lowered = lambda p: [F.lower(c).alias(f"{p}_{c}") for c in ("h", "r", "t")]
    asked = cited.select("qid", *lowered("c")).distinct()
    known = graph.select("qid", *lowered("g")).distinct()
    same = asked.join(known.select("qid", *[F.col(f"g_{c}").alias(f"c_{c}") for c in ("h", "r", "t")]), ["qid", "c_h", "c_r", "c_t"], "left_semi")
    rest = asked.join(same, ["qid", "c_h", "c_r", "c_t"], "left_anti").join(known, "qid")
    for c in ("h", "r", "t"):  # lengths alone rule most pairs out
        a, b = F.length(f"c_{c}"), F.length(f"g_{c}")
        rest = rest.where(200.0 * F.least(a, b) >= F.lit(cutoff) * (a + b))
    for c in ("h", "r", "t"):
        rest = rest.where(token_sort(f"c_{c}", f"g_{c}") >= cutoff)
    found = same.unionByName(rest.select(*same.columns)).distinct().select(F.col("qid").alias("v_qid"), "c_h", "c_r", "c_t", F.lit(True).alias("verified"))
    on = (F.col("qid") == F.col("v_qid")) & (F.lower("h") == F.col("c_h")) & (F.lower("r") == F.col("c_r")) & (F.lower("t") == F.col("c_t"))
    return cited.join(found, on, "left").select(*cited.columns, F.coalesce("verified", F.lit(False)).alias("verified"))


def labelled_steps(steps: DataFrame, graph: DataFrame, cutoff: float = 80.0, least_graph: int = 3) -> DataFrame:
    """``qid``, ``index``, ``label`` of steps (qid, index, body, discourse) by the policy of ``reward.step_label``, all counts taken from the text.

    ``graph``: qid, h, r, t.
    """
    rows = steps.select("qid", "index", "discourse", "body", conclusion_of(F.col("body")).alias("conclusion"), reasoning_of(F.col("body")).alias("reasoning"))
    cited = rows.select("qid", "index", "reasoning", "conclusion", F.posexplode(X.cited_triples(F.col("body"))).alias("pos", "c"))
    cited = verified_citations(cited.select("qid", "index", "pos", "reasoning", "conclusion", "c.*"), graph, cutoff)
    relevant = triple_relevant(F.col("h"), F.col("r"), F.col("t"), F.col("reasoning"), F.col("conclusion"))
    counts = cited.groupBy("qid", "index").agg(F.count(F.lit(1)).alias("cited"), F.count_if("verified").alias("verified"), F.count_if(relevant).alias("relevant"))
    sizes = graph.groupBy("qid").agg(F.count(F.lit(1)).alias("graph"))
    before = Window.partitionBy("qid").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("prior", F.collect_list(F.when(F.col("conclusion") != "", F.col("conclusion"))).over(before))
    rows = rows.join(counts, ["qid", "index"], "left").join(sizes, "qid", "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("cited", "verified", "relevant", "graph")}
    against = R.is_contradiction(F.col("conclusion"), F.col("prior"))
    label = R.step_label(n["cited"], n["verified"], n["relevant"], n["graph"], against, F.col("discourse"), least_graph)
    return rows.select("qid", "index", label.alias("label"))


def hallucination_rate(labels: DataFrame, n_graph: Column) -> DataFrame:
    """``qid``, ``rate``: the share of steps labelled -1; null for a question without a graph. ``labels``: qid, label."""
    return labels.groupBy("qid").agg(F.when(F.max(n_graph) > 0, F.avg((F.col("label") == -1).cast("double"))).alias("rate"))


def kl_rewards(tokens: DataFrame, step_rewards: DataFrame, weight: float) -> DataFrame:
    """Token rewards: minus ``weight`` times the log-ratio to the reference, plus the n-th step reward on the n-th masked token.

    ``tokens``: key, i, logprob, ref_logprob, mask; ``step_rewards``: key, nth (from 1), reward. Keys without step rewards get ``score``, if
    tokens have that column, on their last masked token.
    """
    masked = F.count_if(F.col("mask") == 1)
    order = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = tokens.withColumn("nth", F.when(F.col("mask") == 1, masked.over(order))).withColumn("last", masked.over(Window.partitionBy("key")))
    known = step_rewards.select("key").distinct().withColumn("stepped", F.lit(True))
    rows = rows.join(step_rewards.select("key", "nth", "reward"), ["key", "nth"], "left").join(known, "key", "left")
    score = F.col("score") if "score" in tokens.columns else F.lit(0.0)
    extra = F.when(F.col("stepped"), F.coalesce("reward", F.lit(0.0))).when(F.col("nth") == F.col("last"), score).otherwise(0.0)
    return rows.select("key", "i", (F.lit(-weight) * (F.col("logprob") - F.col("ref_logprob")) + extra).alias("reward"))
