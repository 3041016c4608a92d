"""Resharding by minimum-cost flow: rows move from old shards to new ones of given capacities, as few bytes as possible.

Old shards are sources, new ones sinks; a byte that stays in the shard of the same number costs nothing, any other costs 1 (or what ``cost`` says). The cheapest flow from the old shards'
sizes to the capacities says how many bytes of each old shard go where, and the rows of a shard follow it by their place in the running sum of bytes, largest first: a row goes where its middle lies. So large rows
stay, and what moves is cut between small ones. Equal texts are neighbours in that order, and a cut that would part a small group of them is moved to its end. As a row can't be cut, flows are solved level by level, from rows of an eighth of the mean shard or more down to those under 1/4096 of it: the flow of all that is left
says where the level's rows go, and the next one's capacities are what they really left, so a later level makes up for what an earlier one was off.

The driver sees shard sizes by level (old shards x levels), new sizes and flows, all bounded by the numbers of shards, and no row. Sizes come from the scan; only ids, sizes and
checksums are shuffled, in range partitions, so one shard with most of the rows isn't one task. Texts are read again only to write files, and move only if their shard is affected.

``create`` writes a table as shards with a manifest, ``reshard`` writes the files of affected shards to a new generation, with a manifest that refers to the old files of all others. Nothing is overwritten, so a
job that is lost leaves the old generation as it was.

Edge cases: a null text has no bytes; a shard can't be smaller than a row in it, so rows over the mean take a shard of their own and the others share the rest; equal rows are interchangeable and may part; null ids
share an old shard, in any number; an empty table gives an empty result; more or fewer new shards than old ones are handled alike. Other columns are only carried, under any name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragloom.operators.ranks import ranked
from ragloom.session import cut, fresh

OLD_SHARDS, NEW_SHARDS, ROW_BYTES = 32, 40, 16
#: The largest group that is kept together, as a share of the mean shard.
GROUP_SHARE = 1 / 64
#: Least sizes of the rows of each level, as shares of the mean shard.
LEVELS = (1 / 8, 1 / 64, 1 / 512, 1 / 4096, 0.0)


def cheapest_flow(supply: Sequence[int], capacity: Sequence[int], cost: np.ndarray) -> np.ndarray:
    """Bytes from each source to each sink: all of ``supply``, none over ``capacity``, at the least cost. Successive shortest paths over the residual graph."""
    left, room = np.array(supply, dtype=np.int64), np.array(capacity, dtype=np.int64)
    if left.sum() > room.sum():
        raise ValueError("the capacities don't hold the supply")
    flow = np.zeros((len(left), len(room)), dtype=np.int64)
    cost = np.asarray(cost, dtype=np.float64)
    while left.any():
        # Bellman and Ford: the cheapest way to each source and sink from any source with something left; back over what already flows.
        to_source = np.where(left > 0, 0.0, np.inf)
        to_sink = np.full(len(room), np.inf)
        came, back = np.full(len(room), -1), np.full(len(left), -1)
        while True:
            ways = to_source[:, None] + cost
            best = ways.argmin(axis=0)
            better = ways[best, np.arange(len(room))] < to_sink - 1e-9
            to_sink[better], came[better] = ways[best, np.arange(len(room))][better], best[better]
            ways = np.where(flow > 0, to_sink[None] - cost, np.inf)
            best = ways.argmin(axis=1)
            closer = ways[np.arange(len(left)), best] < to_source - 1e-9
            to_source[closer], back[closer] = ways[np.arange(len(left)), best][closer], best[closer]
            if not closer.any():
                break
        sink = int(np.where(room > 0, to_sink, np.inf).argmin())
        path, at = [], sink
        while True:
            source = int(came[at])
            path.append((source, at, 1))
            if back[source] < 0:
                break
            at = int(back[source])
            path.append((source, at, -1))
        amount = min(left[source], room[sink], *(flow[i, j] for i, j, way in path if way < 0)) if any(way < 0 for *_, way in path) else min(left[source], room[sink])
        for i, j, way in path:
            flow[i, j] += way * amount
        left[source] -= amount
        room[sink] -= amount
    return flow


def levelled(used: np.ndarray, weight: np.ndarray, more: int) -> np.ndarray:
    """What each shard may still take so that all are filled to the same height (in proportion to ``weight``), as far as none has to give back: whole bytes, ``more`` in all."""
    height = used / weight
    order = np.argsort(height, kind="stable")
    room = np.zeros(len(used))
    for n in range(len(used), 0, -1):
        own = order[:n]
        level = (more + used[own].sum()) / weight[own].sum()
        if level >= height[own].max():
            room[own] = level * weight[own] - used[own]
            break
    out = np.floor(np.maximum(room, 0)).astype(np.int64)
    rest = int(more - out.sum())
    out[order[:1]] += min(rest, 0)
    for k in range(max(rest, 0)):
        out[order[k % len(order)]] += 1
    return out


def stay_free(old: int, new: int) -> np.ndarray:
    return 1.0 - np.eye(old, new)


def assign(rows: DataFrame, new: int = NEW_SHARDS, old: int = OLD_SHARDS, weight: Sequence[float] | None = None, cost: np.ndarray | None = None, group: Sequence[str] = ()) -> DataFrame:
    """``rows`` (``old_shard`` from 0, ``size`` and columns that identify a row) with ``shard`` and ``level``, cut off from their lineage.

    ``weight``: the new shards' capacities in proportion; equal ones by default. ``group``: the first of the other columns that rows of a group agree in, as they do in their size. Rows of a group in one old shard
    stay together unless they are over ``GROUP_SHARE`` of the mean shard.
    """
    cost = stay_free(old, new) if cost is None else cost
    weight = np.ones(new) if weight is None else np.array(weight, dtype=np.float64)
    names = [c for c in rows.columns if c not in ("old_shard", "size")]
    order = [F.col("size").desc(), *(F.col(f"`{c}`").asc_nulls_last() for c in names)]
    part, place, before, first = (fresh(x, rows) for x in ("part", "place", "before", "first"))
    spread = rows.repartitionByRange("old_shard", *order).sortWithinPartitions("old_shard", *order)
    placed = cut(spread.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id()))
    parts = placed.groupBy("old_shard", part).agg(F.sum("size").alias("bytes"))
    earlier = Window.partitionBy("old_shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("old_shard", part, F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias(first))  # a row for each partition and shard
    upto = Window.partitionBy("old_shard", part).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn(before, F.sum("size").over(upto) - F.col("size")).join(starts, ["old_shard", part])
    # The row's middle, doubled so that it is whole.
    middle = (2 * (F.col(before) + F.col(first)) + F.col("size")).alias("middle")
    total = placed.agg(F.sum("size")).first()[0] or 0
    limits = [share * total / new for share in LEVELS]
    level = F.lit(len(limits) - 1)
    for k in range(len(limits) - 2, -1, -1):
        level = F.when(F.col("size") >= limits[k], k).otherwise(level)
    summed = cut(summed.select("old_shard", "size", *(F.col(f"`{c}`") for c in names), middle, level.alias("level")))
    sizes = {(r["level"], r["old_shard"]): (r["start"], r["bytes"]) for r in summed.groupBy("level", "old_shard").agg(F.min(F.col("middle") - F.col("size")).alias("start"), F.sum("size").alias("bytes")).collect()}
    used = np.zeros(new, dtype=np.int64)
    arcs: dict[int, list[tuple[int, int]]] = {}
    target = None
    for k in range(len(limits)):
        # The cheapest flow of all that is left; the level's rows, the largest, take its first bytes, and the levels after are planned anew.
        supply = np.array([sum(sizes.get((n, i), (0, 0))[1] for n in range(k, len(limits))) for i in range(old)], dtype=np.int64)
        present = [i for i in range(old) if (k, i) in sizes]
        if not present:
            continue
        flow = cheapest_flow(supply, levelled(used, weight, int(supply.sum())), cost)
        for i in present:
            at = sizes[k, i][0]
            ends = arcs.setdefault(k * old + i, [])
            for j in sorted(np.flatnonzero(flow[i]), key=lambda j: (cost[i, j], j)):
                at += 2 * int(flow[i, j])
                ends.append((at, int(j)))
        if group:
            _keep_together(summed.where(F.col("level") == k), arcs, k * old, ["old_shard", "size", *group], GROUP_SHARE * total / new)
        target = _shard(arcs, old)
        for r in summed.where(F.col("level") == k).groupBy(target.alias("shard")).agg(F.sum("size").alias("bytes")).collect():
            used[r["shard"]] += r["bytes"]
    shard = F.lit(None).cast("int") if target is None else target
    return summed.select("old_shard", "size", *(F.col(f"`{c}`") for c in names), "level", shard.alias("shard"))


def _keep_together(rows: DataFrame, arcs: dict[int, list[tuple[int, int]]], first: int, keys: list[str], most: float) -> None:
    """Moves the ends of arcs that would cut a group of up to ``most`` bytes to the nearer end of the group. Looks at a group for each end, no more."""
    spark = rows.sparkSession
    ends = [(key - first, n, float(at)) for key, list_ in arcs.items() if key >= first for n, (at, _) in enumerate(list_[:-1])]
    if not ends:
        return
    cuts = spark.createDataFrame(ends, "cut_shard int, n int, at double")
    at_cut = (F.col("old_shard") == F.col("cut_shard")) & (F.col("middle") - F.col("size") < F.col("at")) & (F.col("middle") + F.col("size") > F.col("at"))
    hit = rows.join(F.broadcast(cuts), at_cut).select("n", "at", *keys)
    found = rows.join(F.broadcast(cut(hit)), keys).groupBy("n", "at", *keys).agg(F.min(F.col("middle") - F.col("size")).alias("low"), F.max(F.col("middle") + F.col("size")).alias("high"))
    for r in found.collect():  # at most one for each end
        if r["high"] - r["low"] <= 2 * most:
            own = arcs[first + r["old_shard"]]
            own[r["n"]] = (int(r["low"] if r["at"] - r["low"] <= r["high"] - r["at"] else r["high"]), own[r["n"]][1])


def _shard(arcs: dict[int, list[tuple[int, int]]], old: int) -> Column:
    """The shard of the first arc of the row's level and old shard that ends after the row's middle; the last one takes the end."""
    made = F.create_map(*[F.lit(x) if not isinstance(x, list) else F.array(*[F.struct(F.lit(e).cast("long").alias("to"), F.lit(j).alias("shard")) for e, j in x]) for key in sorted(arcs) for x in (key, arcs[key])])
    own = made[F.col("level") * old + F.col("old_shard")]
    return F.coalesce(F.get(F.filter(own, lambda a: a["to"] > F.col("middle")), F.lit(0))["shard"], F.element_at(own, -1)["shard"])


def sized(docs: DataFrame, old: int = OLD_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ``doc_id``, ``size``, ``text_crc32`` and ``old_shard``, by a hash of its text: equal texts start in one shard."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    place = F.pmod(F.xxhash64(text), F.lit(old)).cast("int")
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), place.alias("old_shard"))


def shards(docs: DataFrame, new: int = NEW_SHARDS, old: int = OLD_SHARDS) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``, ``old_shard``: a row for each row of ``docs``; the law is ``bytes``."""
    sizes = sized(docs, old).select("old_shard", "size", "text_crc32", "doc_id")
    placed = ranked(assign(sizes, new, old, group=["text_crc32"]), "shard", [F.col("doc_id").asc_nulls_last(), F.col("text_crc32"), F.col("size"), F.col("old_shard")], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard")


MANIFEST = "generation bigint, shard int, path string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``shard`` and the folder of its files, of the last generation that was finished."""
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    return rows.join(F.broadcast(rows.agg(F.max("generation").alias("generation"))), "generation")


def _write(rows: DataFrame, path: str, generation: int, kept: list[tuple[int, str]], columns: list[str]) -> None:
    """The rows' shards as files of a new generation, then its manifest, which also refers to the shards in ``kept``. A shard's rows are dealt over tasks by their row number."""
    spark = rows.sparkSession
    salt = F.pmod(F.xxhash64(columns[-1]), F.lit(max(1, spark.sparkContext.defaultParallelism // 4)))
    folder = f"{path}/generation={generation}"
    rows.repartition("shard", salt).select("shard", *(F.col(f"`{c}`") for c in columns)).write.partitionBy("shard").parquet(folder)
    written = spark.read.parquet(folder).select("shard").distinct() if not rows.isEmpty() else spark.createDataFrame([], "shard int")
    new = written.select(F.lit(generation).cast("bigint").alias("generation"), F.col("shard").cast("int"), F.concat(F.lit(f"{folder}/shard="), "shard").alias("path"))
    old = spark.createDataFrame([(generation, s, p) for s, p in kept], MANIFEST)
    new.unionByName(old).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def create(docs: DataFrame, path: str, old: int = OLD_SHARDS, id_col: str = "doc_id") -> None:
    """Writes ``docs`` as shards by a hash of the id, with a number for each row, at ``path``, which must be new."""
    row = fresh("row_number", docs)
    numbered = docs.withColumn("shard", F.pmod(F.xxhash64(id_col), F.lit(old)).cast("int")).withColumn(row, F.monotonically_increasing_id())
    _write(numbered, path, 0, [], [*docs.columns, row])


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last generation with their ``shard`` (and the number that ``create`` gave them, the last column but one)."""
    found = [(r["shard"], r["path"]) for r in manifest(spark, path).orderBy("shard").collect()]
    out = None
    for shard, folder in found:
        rows = spark.read.parquet(folder).withColumn("shard", F.lit(shard))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no shard holds a row")
    return out


def reshard(spark: SparkSession, path: str, new: int = NEW_SHARDS, text_col: str = "text", tolerance: float = 0.0, cost: Callable[[int, int], np.ndarray] = stay_free) -> dict[int, int]:
    """Spreads the last generation over ``new`` shards; returns the bytes written for each affected shard.

    Shards that lose and get nothing keep their files. Nothing is written where every shard is within ``tolerance`` of the mean already.
    """
    rows = stored(spark, path)
    columns = rows.columns[:-1]
    number = columns[-1]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = rows.select((F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.col(number).alias("number"), F.col("shard").alias("old_shard"))
    sizes = {r["old_shard"]: r["bytes"] for r in narrow.groupBy("old_shard").agg(F.sum("size").alias("bytes")).collect()}
    mean, old = sum(sizes.values()) / new, max(sizes) + 1
    if len(sizes) == new == old and all(abs(b - mean) <= tolerance * mean for b in sizes.values()):
        return {}
    placed = assign(narrow, new, old, cost=cost(old, new))
    # In order of size and number an old shard's rows are intervals of one level and new shard each; an interval's first row is its bound.
    first = F.struct((-F.col("size")).alias("size"), "number")
    bounds = placed.groupBy("old_shard", "level", "shard").agg(F.min(first).alias("first"), F.sum("size").alias("bytes")).collect()  # at most old x new x levels rows
    lists: dict[int, list] = {}
    gone, moved_to = set(), {}
    for r in sorted(bounds, key=lambda r: (r["old_shard"], tuple(r["first"]))):
        lists.setdefault(r["old_shard"], []).append(((r["first"]["size"], r["first"]["number"]), r["shard"]))
        moved_to[r["shard"]] = moved_to.get(r["shard"], 0) + r["bytes"]
        if r["shard"] != r["old_shard"]:
            gone |= {r["shard"], r["old_shard"]}
    generation = manifest(spark, path).agg(F.max("generation")).first()[0] + 1
    kept = [(r["shard"], r["path"]) for r in manifest(spark, path).collect() if r["shard"] not in gone]
    table = spark.createDataFrame([(s, [(a, b, j) for (a, b), j in x]) for s, x in lists.items() if s in gone], "old_shard int, starts array<struct<size: bigint, number: bigint, to: int>>")
    size = -(F.octet_length(text) + ROW_BYTES).cast("long")
    affected = rows.withColumnRenamed("shard", "old_shard").join(F.broadcast(table), "old_shard")
    before = F.filter("starts", lambda x: (x["size"] < size) | ((x["size"] == size) & (x["number"] <= F.col(f"`{number}`"))))
    _write(affected.withColumn("shard", F.element_at(before, -1)["to"]), path, generation, kept, columns)
    return {s: moved_to.get(s, 0) for s in sorted(gone)}
