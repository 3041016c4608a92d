"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Within a source, every document has the same number of expected copies, target / source size. Documents are put in order, their expected copies are summed
up from the first, one random offset (a hash of the seed and the source) is added, and a document is taken
once for each integer that the running sum crosses on it. Documents are ordered by size, so that the words taken differ
from the target by little more than one document's size (the running error in copies stays within one).

The running sum needs each row's rank in its source. Rows are range-partitioned on (source, size, doc_id), so a source with a third of all rows
is spread over many tasks; ranks come from the place within the partition plus the rows of earlier partitions, a
table of at most partitions x sources rows.

Edge cases: a null or empty text has size 0 and is taken 0 words, though it may be copied; a null source is a
source of its own, last in order; a null doc_id sorts first; repeated rows are documents of their own;
an empty table gives an empty result; ``mixed_rows`` keeps all columns of the input and picks names for its own that don't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragloom.operators.ranks import ranked
from ragloom.session import cut, fresh

WORD = r"[^\x20\x09-\x0D]+"
#: The weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def offset(source: Column, seed: int) -> Column:
    """A uniform number in [0, 1) that depends on the seed and the source alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x00null"))), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, share: float, cap: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source``, ``source_size``, ``target`` from a row for each source: water filling under the caps.

    The excess over a cap goes to the other sources by weight, again and again. The end is known in closed form: order sources by
    cap / weight; the first k are at their caps, the others share what is left by weight. k is the number of
    sources whose cap lies below the level that is reached if all before them are at their caps.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("weight", F.element_at(turn, ((F.row_number().over(order) - 1) % len(weights)) + 1))
    weighed = weighed.withColumn("most", F.lit(cap) * F.col("source_size"))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest, whole = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    weighed = weighed.withColumn("total", F.lit(share) * F.sum("source_size").over(whole))
    weighed = weighed.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    weighed = weighed.withColumn("capped", F.col("most") <= F.col("weight") * F.col("level"))
    # Levels fall from the first source that is not capped on, so none after it is capped; its level holds for them all.
    weighed = weighed.withColumn("final", F.max(F.when(~F.col("capped"), F.col("level"))).over(whole))
    return weighed.select("source", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(F.col("weight") * F.col("final")).alias("target"))


def row_key(docs: DataFrame) -> Column:
    """Equal for rows that are equal in every column alone."""
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"]
    head = F.to_json(F.struct(*others, F.col("text").isNull().alias("none")))
    return F.sha2(F.concat(head, F.coalesce(F.col("text").cast("string"), F.lit(""))), 256)


def copies(docs: DataFrame, share: float = 1.5, cap: float = 2.0, seed: int = 7, keyed: bool = False) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``: a row for each row of ``docs``.

    With ``keyed``, also ``key``, by which ``mixed_rows`` finds the rows again.
    """
    key = [row_key(docs).alias("key")] if keyed else []
    rows = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), *key))
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, cap)
    placed = ranked(rows, "source", [F.col("size").asc(), F.col("doc_id").asc_nulls_first(), *(["key"] if keyed else [])], per_group=goal)
    expected = F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    crossed = F.floor(F.col("expected") * F.col("rank") + F.col("start")) - F.floor(F.col("expected") * (F.col("rank") - 1) + F.col("start"))
    out = placed.withColumn("expected", expected).withColumn("start", offset(F.col("source"), seed))
    out = out.withColumn("copies", F.least(crossed, F.lit(int(cap)).cast("long")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["key"] if keyed else []))


def mixture(docs: DataFrame, share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    return copies(docs, share, cap, seed).select("doc_id", "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``.

    Rows that are equal in every column share the sum of their copies; rows that differ in any column are documents of their own.
    """
    key, n, turn = (fresh(x, docs) for x in ("mix_key", "mix_copies", "mix_turn"))
    plan = copies(docs, share, cap, seed, keyed=True).where("copies > 0").groupBy(F.col("key").alias(key)).agg(F.sum("copies").alias(n))
    taken = docs.withColumn(key, row_key(docs)).join(plan, key).dropDuplicates([key])
    return taken.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*docs.columns)
