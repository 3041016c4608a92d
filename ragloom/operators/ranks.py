"""Ranks within groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragloom.session import cut, fresh


def ranked(rows: DataFrame, group: str, order: list[Column], rank: str = "rank", per_group: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``rank``, from 1 within ``group`` in ``order`` (null is a group; it comes last).

    Rows are range-partitioned on the group and the order, so a large group is spread over tasks. A rank is the place
    within the partition plus the group's rows in earlier partitions: a table of at most partitions x groups rows.
    ``rows`` is read twice (the ranges are sampled), so cut its lineage first if it is dear.
    ``per_group`` holds ``group`` and columns to add to each row, joined without a shuffle on the bare group.
    """
    part, place, g, p, shift = (fresh(x, rows, *([per_group] if per_group is not None else [])) for x in ("part", "place", "g", "p", "shift"))
    spread = rows.repartitionByRange(F.col(group).asc_nulls_last(), *order).sortWithinPartitions(F.col(group).asc_nulls_last(), *order)
    placed = cut(spread.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id()))
    counts = placed.groupBy(group, part).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    earlier = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias(shift)
    starts = counts.select(F.col(group).alias(g), F.col(part).alias(p), before)
    if per_group is not None:
        about = per_group.withColumnRenamed(group, "own_group")
        starts = starts.join(about, F.col(g).eqNullSafe(F.col("own_group"))).drop("own_group")
    joined = placed.join(starts, (F.col(part) == F.col(p)) & F.col(group).eqNullSafe(F.col(g)))
    return joined.withColumn(rank, F.col(place) + F.col(shift)).drop(g, p, shift, part, place)


def batched(rows: DataFrame, size: int, order: list[Column], batch: str = "batch") -> DataFrame:
    """``rows`` with the number of their batch, from 0: ``size`` rows in ``order`` each, the last may have fewer. Rows of a batch are where ``batch`` is equal; a union of batches' results is the whole."""
    one, rank = fresh("one", rows), fresh("rank", rows)
    placed = ranked(rows.withColumn(one, F.lit(0)), one, order, rank)
    return placed.withColumn(batch, F.floor((F.col(rank) - 1) / size)).drop(one, rank)
