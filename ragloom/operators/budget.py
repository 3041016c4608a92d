"""Prompts under a budget of tokens: contexts and sentences that fit, and training rows that lose passages rather than their answer.

Everything of one key (a question with its contexts) is bounded by what was retrieved for it, so windows go by key. Token counts come as columns; ``sft_rows`` and ``anchor_rows`` take an ``encode``
function from a text column to a column of token ids, for which ``encoder`` makes one from a real tokenizer.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragloom.session import fresh

Encode = Callable[[Column], Column]
# What is allowed on top of a target, what stands in for a negative one, the share of the target that sentences get, and what a sentence to be kept gets on its value.
SLACK, LEAST_TARGET, SENTENCE_SHARE, BONUS = 100, 100, 1.4, 100
# Label of a token that isn't trained, and the passages a training prompt starts with.
IGNORED, PASSAGES = -100, 15


def target_of(target: Column | float) -> Column:
    """A target, or the least one in place of a negative one."""
    target = target if isinstance(target, Column) else F.lit(target)
    return F.when(target < 0, F.lit(LEAST_TARGET)).otherwise(target)


def context_budget(contexts: DataFrame, target: Column | float, key: str = "key", place: str = "i", value: str = "value", tokens: str = "tokens", slack: int = SLACK, forced: Column | None = None, order: str = "original", ratio: float = 0.0, strict: bool = False) -> DataFrame:
    """The contexts of each key that a budget of ``target`` plus ``slack`` tokens buys, in order of ``value``, smallest first, ties by ``place``.

    As long as the budget isn't below zero the next context is taken, so the one that crosses it is the last; with ``strict`` it isn't taken. ``forced`` contexts are always taken, first, and pay in their turn.
    Adds ``out``, the place in the prompt (from 1): ``original`` by place, ``ranked`` as taken, ``two_stage`` every second one as taken and then the others backwards; and ``ratio``, from ``ratio`` for the first
    that was taken down to minus that for the last in even steps.
    """
    before, nth, taken, last = (fresh(x, contexts) for x in ("before", "nth", "taken", "last"))
    ranked = Window.partitionBy(key).orderBy(value, place)
    upto = ranked.rowsBetween(Window.unboundedPreceding, 0)
    budget = target_of(target) + F.lit(slack)
    spent = F.sum(tokens).over(upto)
    forced = F.lit(False) if forced is None else F.coalesce(forced, F.lit(False))
    rows = contexts.withColumn(before, spent - (F.lit(0) if strict else F.col(tokens))).withColumn(nth, F.when(forced, F.col(place)))
    rows = rows.where((F.col(before) <= budget) | F.col(nth).isNotNull())
    own = Window.partitionBy(key)
    rows = rows.withColumn(taken, F.row_number().over(own.orderBy(F.col(nth).asc_nulls_last(), value, place)) - 1).withColumn(last, F.count(F.lit(1)).over(own) - 1)
    rows = rows.withColumn("ratio", F.when(F.col(last) > 0, (F.col(last) - 2 * F.col(taken)) * F.lit(abs(ratio)) / F.col(last)).otherwise(0.0))
    if order == "original":
        out = F.row_number().over(own.orderBy(place))
    elif order == "ranked":
        out = F.col(taken) + 1
    elif order == "two_stage":
        half = F.floor(F.col(last) / 2)  # the last of the first stage
        out = F.when(F.col(taken) % 2 == 0, F.col(taken) / 2).otherwise(half + 1 + F.floor((F.col(last) + 1) / 2) - 1 - F.floor(F.col(taken) / 2)) + 1
    else:
        raise ValueError(f"no order {order}")
    return rows.withColumn("out", out.cast("int")).drop(before, nth, taken, last)


def sentence_budget(
    sentences: DataFrame, target: Column | float, key: str = "key", text: str = "i", place: str = "s", value: str = "value", tokens: str = "tokens", keep_first: int = 0, keep_last: int = 0, keep_each: int = 0,
    share: float = SENTENCE_SHARE, largest: bool = True, strict: bool = False,
) -> DataFrame:
    """The sentences of each key's texts that ``share`` times the target buys, by value, largest (or smallest) first, ties by their order; the rows that stay, as they were.

    The first ``keep_first`` and last ``keep_last`` sentences of the key get a bonus on their value, then the ``keep_each`` smallest ones of each text. As long as the budget isn't below zero the next
    sentence is taken; with ``strict`` none that doesn't fit, nor any after it, but kept ones are. The only sentence of a key stays.
    """
    at, back, n, worth, nth, spent = (fresh(x, sentences) for x in ("at", "back", "n", "worth", "nth", "spent"))
    whole = Window.partitionBy(key)
    rows = sentences.withColumn(at, F.row_number().over(whole.orderBy(text, place))).withColumn(n, F.count(F.lit(1)).over(whole))
    bonus = lambda kept: F.when(kept, F.lit(float(BONUS))).otherwise(0.0)
    ends = (F.col(at) <= keep_first, F.col(at) > F.col(n) - keep_last)
    rows = rows.withColumn(worth, F.col(value) + bonus(ends[0]) + bonus(ends[1]))
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(key, text).orderBy(worth, at)))
    rows = rows.withColumn(worth, F.col(worth) + bonus(F.col(nth) <= keep_each)).withColumn(back, ends[0] | ends[1] | (F.col(nth) <= keep_each))
    best = Window.partitionBy(key).orderBy(F.col(worth).desc() if largest else F.col(worth), at).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(spent, F.sum(tokens).over(best) - (F.lit(0) if strict else F.col(tokens)))
    fits = F.col(spent) <= target_of(target) * F.lit(share)
    return rows.where(fits | (F.col(n) == 1) | (F.col(back) if strict else F.lit(False))).drop(at, back, n, worth, nth, spent)


def joined_sentences(kept: DataFrame, key: str = "key", text: str = "i", place: str = "s", sentence: str = "sentence") -> DataFrame:
    """``key``, ``text`` and ``compressed``: each text's kept sentences in their order."""
    return kept.groupBy(key, text).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, sentence))), lambda x: x[sentence]), "").alias("compressed"))


def encoder(make: Callable[[], Callable[[list[str]], list[list[int]]]]) -> Encode:
    """A column function to token ids; ``make`` is called in each task and gives a function from texts to ids. A null text has no tokens."""

    @F.arrow_udf("array<int>")
    def ids(batches: pa.Array) -> pa.Array:
        return pa.array(_made(make)([t or "" for t in batches.to_pylist()]), pa.list_(pa.int32()))

    return ids


_clients: dict = {}


def _made(make: Callable) -> Callable:
    """A task's tokenizer, made at the first batch."""
    key = (make.__module__, make.__qualname__, repr(getattr(make, "__closure__", None) and [c.cell_contents for c in make.__closure__]))
    if key not in _clients:
        _clients[key] = make()
    return _clients[key]


def sft_rows(items: DataFrame, passages: DataFrame, encode: Encode, most: int, top_k: int = PASSAGES, key: str = "key") -> DataFrame:
    """Training rows of at most ``most`` tokens: ``key``, ``input_ids``, ``labels``, ``prompt_length``, ``n_passages``, ``n_dropped``.

    ``items``: key, ``head``, ``tail`` (what stands before and after the passages in the prompt) and ``answer``; ``passages``: key, ``rank`` (from 1), ``text``. Parts are encoded one by one, so a row's length is the
    sum of theirs, and the longest run of first passages that fits with head, tail and whole answer is a search in running sums: lower passages go, the answer stays. A row without an answer's tokens, or too
    long without any passage, is left out (``left_out`` says which). Labels of the prompt are ignored.
    """
    whole = items.select(key, encode(F.col("head")).alias("head"), encode(F.col("tail")).alias("tail"), encode(F.col("answer")).alias("answer"))
    whole = whole.withColumn("room", F.lit(most) - F.size("head") - F.size("tail") - F.size("answer")).where((F.size("answer") > 0) & (F.col("room") >= 0))
    first = passages.where(F.col("rank") <= top_k).select(key, "rank", encode(F.col("text")).alias("ids"))
    upto = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    summed = first.withColumn("sum", F.sum(F.size("ids")).over(upto))
    # Running sums never fall, so the passages whose sum fits are a first run.
    listed = summed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "sum", "ids"))).alias("found"))
    rows = whole.join(listed, key, "left").withColumn("found", F.coalesce("found", F.array().cast(listed.schema["found"].dataType)))
    fits = F.filter("found", lambda x: x["sum"] <= F.col("room"))
    prompt = F.concat("head", F.flatten(F.transform("fits", lambda x: x["ids"])), "tail")
    rows = rows.withColumn("fits", fits).withColumn("prompt", prompt)
    ids, masked = F.concat("prompt", "answer"), F.concat(F.transform("prompt", lambda x: F.lit(IGNORED)), "answer")
    return rows.select(key, ids.alias("input_ids"), masked.alias("labels"), F.size("prompt").alias("prompt_length"), F.size("fits").alias("n_passages"), (F.size("found") - F.size("fits")).alias("n_dropped"))


def left_out(items: DataFrame, encode: Encode, most: int, key: str = "key") -> DataFrame:
    """``key`` and ``reason`` of the items that give no row: no answer, or too long without a passage."""
    size = lambda c: F.size(encode(F.col(c)))
    rows = items.select(key, size("answer").alias("answer"), (size("head") + size("tail") + size("answer")).alias("whole"))
    reason = F.when(F.col("answer") <= 0, "no answer").when(F.col("whole") > most, "too long")
    return rows.select(key, reason.alias("reason")).where("reason is not null")


def anchor_rows(items: DataFrame, encode: Encode, most_prompt: int, most_new: int, key: str = "key") -> DataFrame:
    """Rows that keep a model to its format: ``key``, ``input_ids``, ``labels`` from ``prompt`` and ``answer``, cut to ``most_prompt`` + ``most_new`` tokens.

    The prompt's first ``most_prompt`` tokens are ignored in the labels; what a longer prompt has beyond them is trained, as the answer is. Blank answers give no row.
    """
    rows = items.where(F.trim("answer") != "").select(key, encode(F.col("prompt")).alias("prompt"), encode(F.col("answer")).alias("answer"))
    ids = F.slice(F.concat("prompt", "answer"), 1, most_prompt + most_new)
    ignored = F.least(F.size("prompt"), F.lit(most_prompt))
    return rows.select(key, ids.alias("input_ids"), ignored.alias("ignored")).select(key, "input_ids", F.transform("input_ids", lambda x, i: F.when(i < F.col("ignored"), F.lit(IGNORED)).otherwise(x)).alias("labels"))
