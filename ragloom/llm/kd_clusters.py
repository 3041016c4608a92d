"""Clustering around centroids (Lloyd's rounds) by filtering kd-trees.

Vectors are turned into integers, so that sums, distances and centroids are exact and the result depends on neither the order of rows nor the partitions. Each partition builds kd-trees
over at most ``BLOCK_ROWS`` of its vectors, once. A node holds the box around its vectors, their count and their integer sum. In every round the centroids go down the trees: a centroid that
is farther than another one from every point of a node's box, strictly, leaves that subtree; a node with one centroid left is assigned whole, from its count and sum;
vectors of leaves with several are held against those left, ties to the smaller number. What a partition returns for a round is one row for each centroid.

The trees are a checkpointed table that every round reads; only centroids (a bounded ``clusters`` x ``dims`` numbers) and their sums meet at the driver.

Edge cases: vectors that are null, of another length, or hold null or non-finite components take no part, nor do those with a component of ``LIMIT`` / 256 or more, whose distances need not
fit in a long; a null id is kept, is never chosen as a first centroid before one that isn't null, and equal ids are rows of their own (ordered by vector for the first centroids); with fewer vectors
than clusters there are as many clusters as vectors; equal centroids tie to the smaller number, and a centroid without vectors stays as it was; an empty table gives an empty result. Only id and vector are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.session import cut

CLUSTERS, ROUNDS, DIMS, SCALE = 40, 5, 64, 256
#: Components are smaller than this as integers: squared distances of 64 components then fit in a long.
LIMIT = 1 << 26
#: Under this, all integers of a distance are exact as doubles, whose matrix products are faster.
EXACT = 1 << 21
BLOCK_ROWS, LEAF_ROWS = 8192, 32
TREES = "ids array<bigint>, rows int, vectors binary, low binary, high binary, sums binary"


class Tree:
    """A balanced kd-tree: vectors in its order, and for each node, level by level, the box and the sum. Node i of a level of m has the rows from n * i // m on."""

    def __init__(self, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray) -> None:
        self.vectors, self.low, self.high, self.sums = vectors, low, high, sums
        self.levels = (len(low) + 1).bit_length() - 1

    @staticmethod
    def depth(rows: int, leaf_rows: int) -> int:
        return max(0, (rows // leaf_rows).bit_length() - 1) if leaf_rows else 0

    @classmethod
    def planted(cls, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[Tree, np.ndarray]:
        """The tree of ``vectors``, each node cut at the median of its widest side, and the order that it puts them in."""
        n = len(vectors)
        order, depth = np.arange(n), cls.depth(n, leaf_rows)
        for level in range(depth):
            bound = cls.bounds(n, level + 1)
            for i in range(0, len(bound) - 2, 2):
                a, mid, b = bound[i : i + 3]
                own = order[a:b]
                side = int(np.argmax(vectors[own].max(axis=0) - vectors[own].min(axis=0)))
                order[a:b] = own[np.argpartition(vectors[own, side], mid - a - 1)] if mid > a else own
        vectors = vectors[order]
        start = cls.bounds(n, depth)[:-1]
        low, high, sums = [np.minimum.reduceat(vectors, start)], [np.maximum.reduceat(vectors, start)], [np.add.reduceat(vectors, start, dtype=np.int64)]
        for _ in range(depth):
            low.insert(0, np.minimum(low[0][::2], low[0][1::2]))
            high.insert(0, np.maximum(high[0][::2], high[0][1::2]))
            sums.insert(0, sums[0][::2] + sums[0][1::2])
        return cls(vectors, np.concatenate(low), np.concatenate(high), np.concatenate(sums)), order

    @staticmethod
    def bounds(rows: int, level: int) -> np.ndarray:
        return rows * np.arange((1 << level) + 1) // (1 << level)

    def filtered(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Each row's centroid; count and sum of each centroid; how many rows were assigned by whole nodes."""
        k, n = len(centroids), len(self.vectors)
        largest = max(int(np.abs(self.vectors).max()), int(np.abs(centroids).max()))
        kind = np.float64 if largest < EXACT else np.int64
        c = centroids.astype(kind)
        norms = (c * c).sum(axis=1)
        label = np.full(n, -1, dtype=np.int32)
        counts, sums, whole = np.zeros(k, dtype=np.int64), np.zeros((k, self.vectors.shape[1]), dtype=np.int64), 0
        nodes, left = np.zeros(1, dtype=np.int64), np.ones((1, k), dtype=bool)
        for level in range(self.levels):
            at = (1 << level) - 1 + nodes
            low, high = self.low[at].astype(kind), self.high[at].astype(kind)
            # Near the middle of the box: as 4 d(z, middle)^2 less what all have in common.
            score = np.where(left, 4 * norms - 4 * ((low + high) @ c.T), np.inf)
            nearest = score.argmin(axis=1)
            for z in np.unique(nearest):
                own = np.flatnonzero(nearest == z)
                u = c - c[z]
                # The largest (v - z) u over the box's points v is at one of its corners.
                corner = high[own] @ np.maximum(u, 0).T + low[own] @ np.minimum(u, 0).T - (u @ c[z])[None]
                left[own] &= ~(2 * corner < (u * u).sum(axis=1)[None])
            bound = self.bounds(n, level)
            decided = left.sum(axis=1) == 1
            for node, z in zip(nodes[decided], left[decided].argmax(axis=1)):
                a, b = bound[node], bound[node + 1]
                label[a:b] = z
                counts[z] += b - a
                sums[z] += self.sums[(1 << level) - 1 + node]
                whole += int(b - a)
            nodes, left = nodes[~decided], left[~decided]
            if level < self.levels - 1:
                nodes, left = np.stack((2 * nodes, 2 * nodes + 1), axis=1).ravel(), np.repeat(left, 2, axis=0)
        if len(nodes):
            bound = self.bounds(n, self.levels - 1)
            size = bound[nodes + 1] - bound[nodes]
            rows = np.repeat(bound[nodes] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            v = self.vectors[rows]
            apart = np.where(np.repeat(left, size, axis=0), norms[None] - 2 * (v.astype(kind) @ c.T), np.inf if kind is np.float64 else np.iinfo(np.int64).max)
            best = apart.argmin(axis=1)  # the first of equal ones
            label[rows] = best
            counts += np.bincount(best, minlength=k)
            for z in np.unique(best):
                sums[z] += v[best == z].sum(axis=0, dtype=np.int64)
        return label, counts, sums, whole


def integers(table: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """``id`` and ``v``: the integer vectors that take part."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.size("v") == dims)
    rows = rows.where(F.forall("v", lambda x: F.coalesce(F.abs(x) < LIMIT / scale, F.lit(False))))
    return rows.select("id", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("int")).alias("v"))


def planted(rows: DataFrame, dims: int, block_rows: int = BLOCK_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """The kd-trees of ``rows`` (``id``, ``v``), a row for each, cut off from their lineage."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        parts: list[np.ndarray] = []
        held = 0

        def tree() -> pa.RecordBatch:
            nonlocal held
            one, order = Tree.planted(np.concatenate(parts), leaf_rows)
            own = pa.concat_arrays(ids).take(pa.array(order))
            columns = [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([len(own)], pa.int32())]
            columns += [pa.array([x.tobytes()], pa.binary()) for x in (one.vectors, one.low, one.high, one.sums)]
            ids.clear()
            parts.clear()
            held = 0
            return pa.RecordBatch.from_arrays(columns, names=["ids", "rows", "vectors", "low", "high", "sums"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, block_rows - held)
                ids.append(some.column(0))
                parts.append(some.column(1).flatten().to_numpy().reshape(-1, dims))
                held, at = held + some.num_rows, at + some.num_rows
                if held == block_rows:
                    yield tree()
        if held:
            yield tree()

    return cut(rows.select("id", "v").mapInArrow(plant, TREES))


def trees_of(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, Tree]]:
    for i in range(batch.num_rows):
        read = lambda c, t: np.frombuffer(batch.column(c)[i].as_buffer(), dtype=t).reshape(-1, dims)  # noqa: B023, E731
        yield batch.column(0)[i].values, Tree(read(2, np.int32), read(3, np.int32), read(4, np.int32), read(5, np.int64))


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of each one's mean; one without vectors stays."""
    k, dims = centroids.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for batch in batches:
            for _, tree in trees_of(batch, dims):
                _, n, s, _ = tree.filtered(centroids)
                counts += n
                sums += s
        some = np.flatnonzero(counts)
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * dims, pa.int32()), pa.array(sums[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some]), listed], names=["cluster", "n", "sums"])

    parts = trees.mapInArrow(add_up, "cluster int, n bigint, sums array<bigint>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("dim", "part"))
    total = each.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(19,0)")).alias("total")).collect()  # at most clusters x dims rows
    out = centroids.copy()
    for r in total:
        out[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    return out


def assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``id``, ``cluster``, ``distance`` (squared) of every vector."""
    dims = centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree in trees_of(batch, dims):
                label, *_ = tree.filtered(centroids)
                gap = tree.vectors.astype(np.int64) - centroids[label]
                yield pa.RecordBatch.from_arrays([ids, pa.array(label), pa.array((gap * gap).sum(axis=1))], names=["id", "cluster", "distance"])

    return trees.mapInArrow(assign, "id bigint, cluster int, distance bigint")


def fitted(table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", **trees: int) -> tuple[DataFrame | None, np.ndarray]:
    """The kd-trees (``trees``: ``block_rows``, ``leaf_rows``) and the centroids after ``rounds`` rounds; no trees where no vector takes part.

    The first centroids are the vectors with the smallest SHA-256 of seed, colon and id.
    """
    rows = integers(table, id_col, vector_col, dims, scale)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(drawn.asc_nulls_last(), "v").limit(clusters).collect()
    centroids = np.array([r["v"] for r in first], dtype=np.int64).reshape(-1, dims)
    if not len(centroids):
        return None, centroids
    planted_trees = planted(rows, dims, **trees)
    for _ in range(rounds):
        centroids = moved(planted_trees, centroids)
    return planted_trees, centroids


def cluster(table: DataFrame, **options) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256``: a row for each vector that takes part; ``options`` as for ``fitted``."""
    trees, centroids = fitted(table, **options)
    spark = table.sparkSession
    if trees is None:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    named = spark.createDataFrame([(i, digest(c)) for i, c in enumerate(centroids)], "c int, centroid_sha256 string")
    found = cut(assigned(trees, centroids))
    per = found.groupBy(F.col("cluster").alias("c")).agg(F.sum(F.col("distance").cast("decimal(19,0)")).cast("bigint").alias("cluster_inertia"))
    whole = per.agg(F.sum("cluster_inertia").alias("inertia"))
    about = per.crossJoin(F.broadcast(whole)).join(named, "c")  # a row for each cluster
    joined = found.join(F.broadcast(about), F.col("cluster") == F.col("c"))
    return joined.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
