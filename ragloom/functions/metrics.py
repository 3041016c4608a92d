"""Answer metrics as column functions, and a registry of them.

All compare normalised texts. Golden answers are arrays; a score is the best over them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions import text as X
from ragloom.session import fresh


def let(fn: Callable[..., Column], *values: Column) -> Column:
    """``fn`` of the values, each computed once however often ``fn`` uses it, inside higher-order functions too."""
    bound = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.get(F.transform(F.array(bound), lambda s: fn(*[s[f"v{i}"] for i in range(len(values))])), F.lit(0))


def numbered(items: Column) -> Column:
    """Sorted items with the number of their occurrence, so that a set of them is the multiset."""
    return let(lambda s: F.transform(s, lambda w, i: F.concat(w, F.lit("\x00"), (i + 1 - F.array_position(s, w)).cast("string"))), F.array_sort(items))


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays of words."""
    return F.size(F.array_intersect(numbered(a), numbered(b)))


def token_scores(pred: Column, gold: Column) -> Column:
    """precision, recall, f1 of two normalised texts; zeros without a common word."""

    def scores(p: Column, g: Column) -> Column:
        def rates(same: Column, n: Column, m: Column) -> Column:
            pr, rc = same / n, same / m
            full = F.struct(pr.alias("precision"), rc.alias("recall"), (2 * pr * rc / (pr + rc)).alias("f1"))
            return F.when(same > 0, full).otherwise(F.struct(F.lit(0.0).alias("precision"), F.lit(0.0).alias("recall"), F.lit(0.0).alias("f1")))

        return let(rates, overlap(p, g).cast("double"), F.size(p), F.size(g))

    return let(scores, X.words(pred), X.words(gold))


def em(pred: Column, golds: Column, norm: Callable[[Column], Column] = X.norm_core) -> Column:
    return let(lambda p: F.when(F.exists(golds, lambda g: norm(g) == p), 1.0).otherwise(0.0), norm(pred))


def em_pattern(pred: Column, golds: Column) -> Column:
    """Whether the whole normalised prediction matches a golden answer taken as a pattern, case aside."""
    return let(lambda p: F.when(F.exists(golds, lambda g: F.rlike(p, F.concat(F.lit(r"(?i)\A(?:"), g, F.lit(r")\z")))), 1.0).otherwise(0.0), X.norm_toolkit(pred))


def data_set_golds(rows: DataFrame, choices: str = "choices", indexes: str = "indexes", answers: str = "golden_answers", out: str = "golds") -> DataFrame:
    """``rows`` with the golden answers to score against: the texts of the chosen choices if every row has choices, else every row's own answers."""
    mixed = fresh("mixed", rows)
    whole = rows.agg(F.coalesce(F.bool_or(F.coalesce(F.size(choices), F.lit(0)) <= 0), F.lit(False)).alias(mixed))
    chosen = F.transform(indexes, lambda i: F.get(choices, i))
    return rows.crossJoin(F.broadcast(whole)).withColumn(out, F.when(F.col(mixed), F.col(answers)).otherwise(chosen)).drop(mixed)


def f1(pred: Column, golds: Column) -> Column:
    """Multiset word F1 with the best golden answer."""
    return let(lambda p: F.coalesce(F.array_max(F.transform(golds, lambda g: token_scores(p, X.norm_core(g))["f1"])), F.lit(0.0)), X.norm_core(pred))


def toolkit_scores(pred: Column, golds: Column) -> Column:
    """precision, recall, f1, each with its own best golden answer; yes, no and noanswer only match themselves."""
    closed = ("yes", "no", "noanswer")
    names = ("precision", "recall", "f1")

    def one(p: Column, n: Column) -> Column:
        barred = (p.isin(*closed) | n.isin(*closed)) & (p != n)
        return F.when(barred, F.struct(*[F.lit(0.0).alias(k) for k in names])).otherwise(token_scores(p, n))

    scored = let(lambda p: F.transform(golds, lambda g: let(lambda n: one(p, n), X.norm_toolkit(g))), X.norm_toolkit(pred))
    return let(lambda x: F.struct(*[F.coalesce(F.array_max(F.transform(x, _field(k))), F.lit(0.0)).alias(k) for k in names]), scored)


def _field(name: str) -> Callable[[Column], Column]:
    def get(s: Column) -> Column:
        return s[name]

    return get


def sub_em(pred: Column, golds: Column) -> Column:
    """Whether a golden answer is part of the prediction; one of articles alone is part of any."""
    return let(lambda p: F.when(F.exists(golds, lambda g: F.contains(p, X.norm_toolkit(g))), 1.0).otherwise(0.0), X.norm_toolkit(pred))


def answer_match(pred: Column, gold: Column) -> Column:
    """Lenient match in [0, 1]: equality or containment as whole words, else the best of word recall and F1, raw and cleaned."""
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))

    def recall(p: Column, g: Column) -> Column:
        return let(lambda have, want: F.size(F.filter(want, lambda w: F.array_contains(have, w))) / F.size(want), X.words(p), X.words(g))

    def score(full: Column, clean: Column, g: Column) -> Column:
        inside = F.contains(padded(full), padded(g)) | F.contains(padded(clean), padded(g))
        best = F.greatest(recall(full, g), recall(clean, g), token_scores(full, g)["f1"], token_scores(clean, g)["f1"])
        return F.when(g == "", 0.0).when(inside, 1.0).otherwise(best)

    found = let(score, X.norm_core(pred), X.norm_core(X.clean_final_answer(pred)), X.norm_core(gold))
    return F.when((F.coalesce(pred, F.lit("")) == "") | (F.coalesce(gold, F.lit("")) == ""), 0.0).otherwise(found)


def recall_at(docs: Column, golds: Column, k: int) -> Column:
    """Whether any of the first ``k`` documents holds a golden answer."""
    return F.when(F.exists(F.slice(docs, 1, k), lambda d: F.exists(golds, lambda g: F.contains(X.norm_toolkit(d), X.norm_toolkit(g)))), 1.0).otherwise(0.0)


def precision_at(docs: Column, golds: Column, k: int) -> Column:
    """Share of the returned first ``k`` documents that hold a golden answer; 0 if none is returned."""
    first = F.slice(docs, 1, k)
    hits = F.filter(first, lambda d: F.exists(golds, lambda g: F.contains(X.norm_toolkit(d), X.norm_toolkit(g))))
    return F.when(F.size(first) > 0, F.size(hits) / F.size(first)).otherwise(0.0)


def ngrams(tokens: Column, n: int) -> Column:
    """The n-grams of an array of words, joined by spaces."""
    last = F.size(tokens) - (n - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def rouge_n(pred: Column, gold: Column, n: int) -> Column:
    """ROUGE-N F1 on multisets of n-grams of lower-case words."""

    def score(p: Column, g: Column) -> Column:
        return let(lambda same: F.when(same > 0, 2 * same / (F.size(p) + F.size(g))).otherwise(0.0), overlap(p, g).cast("double"))

    return let(score, let(lambda w: ngrams(w, n), X.ascii_terms(pred)), let(lambda w: ngrams(w, n), X.ascii_terms(gold)))


def bleu_tokens(text: Column) -> Column:
    """Words with punctuation set apart, but for points and commas inside numbers."""
    out = F.replace(F.replace(F.replace(text, F.lit("<skipped>"), F.lit("")), F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))
    for name, sign in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for pattern, repl in ((r"([{-~\[-` -&(-+:-@/])", " $1 "), (r"([^0-9])([.,])", "$1 $2 "), (r"([.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 ")):
        out = F.regexp_replace(out, pattern, repl)
    return F.filter(F.split(out, r"\s+"), lambda w: w != "")


def bleu(pairs: DataFrame, pred: str = "pred", gold: str = "gold", most: int = 4) -> DataFrame:
    """Corpus BLEU of one reference each: clipped n-gram matches are counted in each row and summed up."""
    tokens = pairs.select(bleu_tokens(F.col(pred)).alias("p"), bleu_tokens(F.col(gold)).alias("g"))
    cells = [F.size("p").alias("lp"), F.size("g").alias("lg")]
    for n in range(1, most + 1):
        cells.append(overlap(ngrams(F.col("p"), n), ngrams(F.col("g"), n)).alias(f"m{n}"))
        cells.append(F.greatest(F.size("p") - (n - 1), F.lit(0)).alias(f"c{n}"))
    sums = tokens.select(*cells).groupBy().sum().toDF("lp", "lg", *[f"{k}{n}" for n in range(1, most + 1) for k in "mc"])
    precision = [F.when(F.col(f"c{n}") > 0, F.col(f"m{n}") / F.col(f"c{n}")).otherwise(0.0) for n in range(1, most + 1)]
    mean = F.when(F.least(*precision) > 0, F.exp(sum((F.log(p) / most for p in precision[1:]), F.log(precision[0]) / most))).otherwise(0.0)
    ratio = F.col("lp") / F.col("lg")
    return sums.select((mean * F.when(ratio > 1, 1.0).otherwise(F.exp(1 - 1 / ratio))).alias("bleu"), ratio.alias("ratio"), *[p.alias(f"p{i}") for i, p in enumerate(precision, 1)])


#: name -> column function of (prediction, golden answers). Add to it to plug in a metric.
REGISTRY: dict[str, Callable[[Column, Column], Column]] = {
    "em": em,
    "f1": f1,
    "toolkit_em": lambda p, g: em(p, g, X.norm_toolkit),
    "toolkit_f1": lambda p, g: toolkit_scores(p, g)["f1"],
    "precision": lambda p, g: toolkit_scores(p, g)["precision"],
    "recall": lambda p, g: toolkit_scores(p, g)["recall"],
    "acc": sub_em,
}


def evaluate(rows: DataFrame, metrics: list[str], pred: str = "pred", golds: str = "golden_answers") -> DataFrame:
    """One row of corpus means; 0 for an empty table. An unknown metric raises."""
    return rows.agg(*[F.coalesce(F.avg(REGISTRY[m](F.col(pred), F.col(golds))), F.lit(0.0)).alias(m) for m in metrics])
