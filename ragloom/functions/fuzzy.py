"""Fuzzy matching: what Spark's functions lack, as vectorised Arrow functions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window


def lcs_length(a, b) -> int:
    """Length of the longest common subsequence, by bit-parallel rows (a Python integer holds a row)."""
    if not a or not b:
        return 0
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for y in b:
        match = row & where.get(y, 0)
        row = ((row + match) | (row - match)) & whole
    return len(a) - row.bit_count()


def token_sort_ratio(a: str | None, b: str | None) -> float:
    """100 * 2 * LCS / total length of the two texts with their words sorted."""
    x, y = " ".join(sorted((a or "").split())), " ".join(sorted((b or "").split()))
    return 100.0 if not x and not y else 200.0 * lcs_length(x, y) / (len(x) + len(y))


@F.arrow_udf(DoubleType())
def token_sort(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([token_sort_ratio(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


@F.arrow_udf(DoubleType())
def rouge_l(pred: pa.Array, gold: pa.Array) -> pa.Array:
    """ROUGE-L F1 on lower-case words."""
    out = []
    for p, g in zip(pred.to_pylist(), gold.to_pylist()):
        x, y = (p or "").lower().split(), (g or "").lower().split()
        same = lcs_length(x, y)
        out.append(2.0 * same / (len(x) + len(y)) if same else 0.0)
    return pa.array(out, pa.float64())


def word_sorted(text: Column) -> Column:
    """A text with its words sorted, as ``token_sort_ratio`` compares it."""
    return F.array_join(F.array_sort(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")), " ")


#: The least ratio at which a text is known to keep a pair of neighbouring letters of every text like it.
LEAST_CUTOFF = 67.0
#: Labels of a key that are compared in one task; more are dealt over parts.
KEY_ROWS = 4096


def _prefix_size(size: Column, cutoff: float) -> Column:
    """How many of a text's letter pairs, in one order for all texts, have to be looked at so that two texts at the cutoff share one of those.

    Texts of a and b letters at a ratio c have L >= c (a + b) / 2 letters in common in order. A letter of the one that isn't costs two of its pairs, one of the other's at most one, so at most
    2 (a - L) + (b - L) of the a + 1 pairs (the ends count as letters) aren't shared; over all b that the ratio allows that is largest for the shortest.
    """
    c = cutoff / 100.0
    shortest = F.ceil(size * F.lit(c / (2 - c)) - 1e-9)
    return F.floor(size * F.lit(2 - 1.5 * c) + shortest * F.lit(1 - 1.5 * c) + 1e-9).cast("int") + 1


def _letter_pairs(texts: DataFrame) -> DataFrame:
    """``text``, ``size``, ``key``: each pair of neighbouring letters of a text (the ends marked), with a number for each repeat."""
    marked = F.concat(F.lit("\x02"), "text", F.lit("\x03"))
    each = texts.select("text", F.explode(F.transform(F.sequence(F.lit(1), F.length("text") + 1), lambda i: F.substring(marked, i, F.lit(2)))).alias("pair"))
    counted = each.groupBy("text", "pair").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("text", F.length("text").alias("size"), F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("n")), lambda i: F.concat("pair", i.cast("string")))).alias("key"))


def fuzzy_link(mentions: DataFrame, labels: DataFrame, cutoff: float = 85.0) -> DataFrame:
    """The best label for each mention at a ratio of ``cutoff`` (67 or more) or over, ties to the smaller label: mention, label, ratio.

    Complete: candidates share a letter pair among the rarest of each, of as many as no pair of texts at the cutoff can all miss; lengths that the ratio rules out aren't compared. Pairs of letters
    that many labels still have are dealt over parts. Empty texts are linked to none.
    """
    if cutoff < LEAST_CUTOFF:
        raise ValueError(f"the cutoff is at least {LEAST_CUTOFF}")
    left = mentions.select("mention").distinct().withColumn("text", word_sorted(F.col("mention"))).where("text <> ''")
    right = labels.select("label").distinct().withColumn("text", word_sorted(F.col("label"))).where("text <> ''")
    pairs = [_letter_pairs(side.select("text").distinct()) for side in (left, right)]
    often = pairs[0].unionByName(pairs[1]).groupBy("key").agg(F.count(F.lit(1)).alias("often"))
    rarest = Window.partitionBy("text").orderBy("often", "key")
    a, b = (p.join(often, "key").withColumn("nth", F.row_number().over(rarest)).where(F.col("nth") <= _prefix_size(F.col("size"), cutoff)).select("text", "size", "key") for p in pairs)
    hot = b.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / KEY_ROWS).cast("int").alias("parts")).where("parts > 1")
    part_of = lambda rows, part: rows.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", part)
    a = part_of(a, F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", "part", F.col("text").alias("a"), F.col("size").alias("a_size"))
    b = part_of(b, F.pmod(F.xxhash64("text"), F.col("parts")).cast("int")).select("key", "part", F.col("text").alias("b"), F.col("size").alias("b_size"))
    # 2 L / (a + b) is at most 2 min(a, b) / (a + b).
    near = 2 * F.least("a_size", "b_size") >= F.lit(cutoff / 100.0 - 1e-9) * (F.col("a_size") + F.col("b_size"))
    found = a.join(b, ["key", "part"]).where(near).select("a", "b").distinct()
    found = found.withColumn("ratio", token_sort("a", "b")).where(F.col("ratio") >= cutoff)
    scored = left.join(found, left["text"] == found["a"]).join(right.select("label", F.col("text").alias("b")), "b").select("mention", "label", "ratio")
    best = Window.partitionBy("mention").orderBy(F.col("ratio").desc(), "label")
    first = scored.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")
    return mentions.join(first, "mention", "left")
