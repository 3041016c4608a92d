"""Curation of training traces: filters, quotas, mining, mixing, resuming."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ragloom.operators.ranks import ranked
from ragloom.session import fresh

# Quotas of the accepted traces by bucket, and the buckets' least triple rates.
SPARSE_QUOTA, MEDIUM_QUOTA, RICH_RATE, MEDIUM_RATE = 0.25, 0.35, 0.5, 0.15


def silver_ok(steps: Column, coverage: Column, f1: Column, triple_rate: Column) -> Column:
    """Three to seven steps, and coverage, answer F1 and triple rate high enough."""
    return steps.between(3, 7) & (coverage >= 0.5) & (f1 >= 0.5) & (triple_rate >= 0.4)


def bucket_of(triple_rate: Column) -> Column:
    return F.when(triple_rate >= RICH_RATE, "kg_rich").when(triple_rate >= MEDIUM_RATE, "kg_medium").otherwise("kg_sparse")


def quality_ok(steps: Column, answer_score: Column) -> Column:
    return steps.between(3, 7) & (answer_score >= 0.3)


def stratified_quota(rows: DataFrame, stream: str, order: str) -> DataFrame:
    """Sequential acceptance within each stream: rows have ``bucket`` (null: below quality); adds ``accepted``.

    A sparse or medium row is accepted while its bucket is under its share of the accepted rows plus one; the first row ever is. The decision depends on all
    rows before it, so one task folds a stream, sorted by ``order`` (which may spill), batch by batch with three counters for state; streams run in parallel.
    A null stream is one of its own.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts = None, {}
        for batch in batches:
            accepted = []
            for name, bucket in zip(batch.column(place).to_pylist(), batch.column(kind).to_pylist()):
                if at is None or at[0] != name:
                    at, counts = (name,), dict.fromkeys(("kg_rich", "kg_medium", "kg_sparse"), 0)
                total = sum(counts.values())
                share = {"kg_sparse": SPARSE_QUOTA, "kg_medium": MEDIUM_QUOTA}.get(bucket)
                ok = bucket is not None and (total == 0 or share is None or counts[bucket] < share * (total + 1))
                if ok and bucket in counts:
                    counts[bucket] += 1
                accepted.append(ok)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(accepted, pa.bool_())], names=[*batch.schema.names, "accepted"])

    place, kind = rows.columns.index(stream), rows.columns.index("bucket")
    dealt = rows.repartition(stream).sortWithinPartitions(stream, order, "bucket")
    return dealt.mapInArrow(fold, StructType([*rows.schema.fields, StructField("accepted", BooleanType())]))


def resume(work: DataFrame, done: DataFrame, key: str, most: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Work that isn't done yet; with ``most`` only so much of it, the first in ``order`` (the key by default), so a cap counts new work alone."""
    left = work.join(done.select(key), key, "left_anti")
    return left if most is None else left.orderBy(*(order or [key])).limit(most)


def overlap_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys in both, in the first alone and in the second alone."""
    both = a.select(key).distinct().withColumn("in_a", F.lit(1)).join(b.select(key).distinct().withColumn("in_b", F.lit(1)), key, "full")
    return both.agg(F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("both"), F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"))


def hash_order(key: Column, seed: int) -> Column:
    """A portable random order: the SHA-256 of the key and a seed."""
    return F.sha2(F.concat(key.cast("string"), F.lit(f":{seed}")), 256)


def hash_sample(rows: DataFrame, key: str, n: Column, seed: int = 42, group: str | None = None) -> DataFrame:
    """The first ``n`` rows in hash order, of all rows or of each group; ranks are computed without gathering a group in one task."""
    own, digest, rank = fresh("sample_group", rows) if group is None else group, fresh("sample_hash", rows), fresh("sample_rank", rows)
    marked = rows.withColumn(digest, hash_order(F.col(key), seed))
    marked = marked.withColumn(own, F.lit(0)) if group is None else marked
    kept = ranked(marked, own, [F.col(digest), F.col(key)], rank).where(F.col(rank) <= n)
    return kept.drop(digest, rank, *([own] if group is None else []))


def hard_mix(hard: DataFrame, easy: DataFrame, key: str, ratio: float = 0.7, seed: int = 42) -> DataFrame:
    """All hard rows, and as many easy ones that the hard make up ``ratio`` of the mix; marked by ``hard``."""
    n = int(hard.count() / ratio * (1 - ratio))
    return hard.withColumn("hard", F.lit(True)).unionByName(hash_sample(easy, key, F.lit(n), seed).withColumn("hard", F.lit(False)))


def split_and_merge(rows: DataFrame, condition: Column, then, otherwise) -> DataFrame:
    """Rows sent down one of two branches, and their results together; a null condition goes down the second."""
    chosen = F.coalesce(condition, F.lit(False))
    return then(rows.where(chosen)).unionByName(otherwise(rows.where(~chosen)), allowMissingColumns=True)


def route(score: Column, low: float, high: float) -> Column:
    """Three-way routing by difficulty."""
    return F.when(score < low, "A").when(score < high, "B").otherwise("C")


def severed(triples: DataFrame, matches: Column, key: str, entities: tuple[str, ...], relations: tuple[str, ...]) -> DataFrame:
    """Triples with those that match replaced by noise, picked by a hash of the row's key; ``severed`` marks them."""
    pick = lambda values, salt: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.crc32(F.concat(F.col(key).cast("string"), F.lit(salt)).cast("binary")), F.lit(len(values))) + 1).cast("int"))
    rows = triples.withColumn("severed", F.coalesce(matches, F.lit(False)))
    new = {"h": pick(entities, "h"), "r": pick(relations, "r"), "t": pick(entities, "t")}
    return rows.select(*[F.when(F.col("severed"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns])
