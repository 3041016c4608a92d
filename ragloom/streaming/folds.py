"""Streaming forms of the order-dependent folds. Each equals its batch form once its input has been read."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ragloom.operators import curate
from ragloom.session import scratch_path
from ragloom.sources import sinks


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table, one file or a folder of them, as an incremental source."""
    reader = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    return reader.parquet(f"{sf_dir}/{name}.parque[t]")  # as a pattern, since a bare path must be a folder


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is, exactly once, into a table in the shared folder, and read that."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}-state").option("path", path).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def keyed_last(stream: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The changes of each key's last value: key, value, ``at`` (the order, as numbers), with one value for each key as state.

    Order columns are timestamps or integers. A batch of a key is read in pieces, of which only the last row counts, so a hot key's batch isn't held as a whole; a row no later than the state changes nothing.
    """
    as_number = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if stream.schema[c].dataType.typeName().startswith("timestamp") else F.col(c).cast("long")
    rows = stream.select(F.col(key).alias("key"), F.col(value).cast("string").alias("value"), *[as_number(c).alias(f"at{i}") for i, c in enumerate(order)])
    places = [f"at{i}" for i in range(len(order))]

    def fold(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        changed = False
        for frame in frames:
            top = frame.sort_values(places).iloc[-1]
            at = tuple(int(top[c]) for c in places)
            if last is None or at > tuple(last[1:]):
                last, changed = (None if pd.isna(top["value"]) else str(top["value"]), *at), True
        if changed:
            state.update(last)
            yield pd.DataFrame({"key": [keys[0]], "value": pd.Series([last[0]], dtype="object"), **{c: [last[1 + i]] for i, c in enumerate(places)}})

    kind = rows.schema["key"].dataType.simpleString()
    of = ", ".join(f"{c} long" for c in places)
    changes = rows.groupBy("key").applyInPandasWithState(fold, f"key {kind}, value string, {of}", f"value string, {of}", "update", GroupStateTimeout.NoTimeout)
    back = F.col("value").cast(stream.schema[value].dataType)
    return changes.select(F.col("key").alias(key), back.alias(value), F.struct(*places).alias("at"))


def last_wins(stream: DataFrame, key: str, value: str, order: list[str], base: str | None = None) -> DataFrame:
    """Fold an append-only stream to the last value of each key: a batch writes what it changed, and the changes are folded once at the end.

    With the ``base`` of an earlier run it goes on from there: state, changes and the place in the source are kept. A batch that is run again after a failure overwrites its own changes.
    """
    spark = stream.sparkSession
    base = base or scratch_path(spark, "fold")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/changes/batch={number}")

    query = keyed_last(stream, key, value, order).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    folded = f"{base}/folded-{uuid.uuid4().hex}"
    sinks.compact(f"{base}/changes", folded, spark, key, value, "at")
    return spark.read.parquet(folded).select(key, value)


def windowed(stream: DataFrame, time: str, keys: list[str], value: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums in tumbling windows under a watermark."""
    out = stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total")


def quota(stream: DataFrame, key: str, order: str) -> DataFrame:
    """``curate.stratified_quota`` with the counts of each stream key kept as state; a batch is folded in order."""

    def fold(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts = dict(zip(("kg_rich", "kg_medium", "kg_sparse"), state.get if state.exists else (0, 0, 0)))
        rows = pd.concat(list(frames)).sort_values(order)
        accepted = []
        for bucket in rows["bucket"]:
            total = sum(counts.values())
            share = {"kg_sparse": curate.SPARSE_QUOTA, "kg_medium": curate.MEDIUM_QUOTA}.get(bucket)
            ok = isinstance(bucket, str) and (total == 0 or share is None or counts[bucket] < share * (total + 1))
            counts[bucket] = counts.get(bucket, 0) + 1 if ok else counts.get(bucket, 0)
            accepted.append(bool(ok))
        state.update(tuple(counts[k] for k in ("kg_rich", "kg_medium", "kg_sparse")))
        yield rows.assign(accepted=accepted)[[order, key, "bucket", "accepted"]]

    schema = stream.select(order, key, "bucket").schema
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", accepted boolean"
    return stream.select(order, key, "bucket").groupBy(key).applyInPandasWithState(fold, out, "rich long, medium long, sparse long", "append", GroupStateTimeout.NoTimeout)
