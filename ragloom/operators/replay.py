"""Draws with replacement that depend on a seed, the row's place and nothing else: no driver, no order of tasks, the exact number of draws.

A draw is a number: a hash of the seed and the draw's own number, modulo the rows. Rows are numbered in order of a key by range partitions (``ranks.ranked``), and draws, which are few beside the rows or many,
are counted by number before they are joined, so a rerun under other partitions gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.operators.ranks import ranked
from ragloom.session import cut, fresh


def uniform(seed: int, *parts: Column) -> Column:
    """A number under 2^60 from a hash of the seed and the parts: the first fifteen digits of their SHA-256."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def numbered(rows: DataFrame, key: str, number: str) -> tuple[DataFrame, int]:
    """``rows`` with a gapless ``number`` from 0 in order of ``key``, and how many there are."""
    one = fresh("one", rows)
    out = cut(ranked(rows.withColumn(one, F.lit(0)), one, [F.col(key)], number).withColumn(number, F.col(number) - 1).drop(one))
    return out, out.count()


def drawn(rows: DataFrame, n: int, seed: int, key: str, copies: str = "copies") -> DataFrame:
    """``rows`` that ``n`` draws with replacement hit, with how often; no rows give none."""
    number = fresh("number", rows)
    placed, count = numbered(rows, key, number)
    hits = rows.sparkSession.range(n).select(F.pmod(uniform(seed, F.col("id")), F.lit(max(count, 1))).alias(number)).groupBy(number).agg(F.count(F.lit(1)).alias(copies))
    return placed.join(hits, number).drop(number)


def replay_mix(explore: DataFrame, replay: DataFrame, batches: int, size: int, ratio: float, seed: int, key: str = "key") -> DataFrame:
    """``batch``, ``slot``, ``kind``, ``key``: batches of ``size`` rows, the first of which explore and int(``size`` * ``ratio``) replay, each drawn with replacement from its table.

    Without rows to replay all slots explore.
    """
    old, n_old = numbered(replay.select(F.col(key).alias("key")), "key", "number")
    new, n_new = numbered(explore.select(F.col(key).alias("key")), "key", "number")
    n_replay = int(size * ratio) if n_old else 0
    if not n_new:
        raise ValueError("there is no row to explore")
    slots = explore.sparkSession.range(batches * size).select(F.floor(F.col("id") / size).alias("batch"), (F.col("id") % size).alias("slot"))
    slots = slots.withColumn("kind", F.when(F.col("slot") < size - n_replay, "explore").otherwise("replay"))
    slots = slots.withColumn("number", F.pmod(uniform(seed, F.col("kind"), F.col("batch"), F.col("slot")), F.when(F.col("kind") == "explore", F.lit(n_new)).otherwise(F.lit(max(n_old, 1)))))
    both = new.withColumn("kind", F.lit("explore")).unionByName(old.withColumn("kind", F.lit("replay")))
    return slots.join(both, ["kind", "number"]).select("batch", "slot", "kind", "key")
