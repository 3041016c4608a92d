import hashlib

import numpy as np
import pytest

from ragloom.llm import kd_clusters

SCHEMA = "vec_id long, embedding array<double>, cluster string"


def lloyd(rows, clusters, rounds, dims, scale=256):
    """Plain Lloyd's rounds in Python integers: sorted (vec_id, cluster, distance), centroids."""
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    draw = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=draw)[:clusters]]
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min((apart(v, c), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else c for k, c in enumerate(centroids)]
    return sorted((str(i), *nearest(v)[::-1]) for i, v in kept), centroids


def check(spark, rows, clusters=7, rounds=4, dims=3, partitions=3, **trees):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA).repartition(partitions)
    got = kd_clusters.cluster(df, clusters=clusters, rounds=rounds, dims=dims, **trees).collect()
    wanted, centroids = lloyd(rows, clusters, rounds, dims)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got) == wanted
    per = {}
    for _, c, d in wanted:
        per[c] = per.get(c, 0) + d
    for r in got:
        assert (r.cluster_inertia, r.inertia) == (per[r.cluster], sum(per.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()
    return got


@pytest.mark.parametrize("trees", [{}, {"block_rows": 50, "leaf_rows": 1}, {"block_rows": 64, "leaf_rows": 5}])
def test_equals_plain_rounds(spark, trees):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(9, 3)) * 4
    rows = [(i, (middle[i % 9] + rng.normal(size=3) * 0.3).tolist()) for i in range(600)]
    check(spark, rows, clusters=9, **trees)


def test_ties_repeats_and_hot_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-1, 2, 3)]) for i in range(200)] + [(i, [0.5, -0.5, 0.25]) for i in range(300)] + [(5, [1.0, 1.0, 1.0])] * 4 + [(None, [2.0, 2.0, 2.0])] * 2
    check(spark, rows, clusters=20, rounds=5, leaf_rows=2)


def test_large_integers_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=3) * 60_000).tolist()) for i in range(150)]
    assert max(r.distance for r in check(spark, rows, clusters=4, leaf_rows=4)) > 1 << 40


def test_unusable_vectors_few_vectors_and_empty_table(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [1.0, 2.0]), (3, [1.0, None, 2.0]), (4, [nan, 1.0, 1.0]), (5, [inf, 1.0, 1.0]), (6, []), (7, [0.0, 0.0, 0.0]), (8, [1.0, 1.0, -1.0])]
    assert len(check(spark, rows)) == 2
    beyond = spark.createDataFrame([(1, [1e30, 0.0, 0.0], "x"), (2, [1.0, 0.0, 0.0], "x")], SCHEMA)
    assert [r.vec_id for r in kd_clusters.cluster(beyond, dims=3).collect()] == [2]
    assert kd_clusters.cluster(spark.createDataFrame([], SCHEMA)).collect() == []
    assert kd_clusters.cluster(spark.createDataFrame([(1, None, "x")], SCHEMA)).collect() == []


def test_nodes_are_assigned_whole_and_only_if_strictly_nearer():
    rng = np.random.default_rng(6)
    centroids = np.array([[0, 0], [1000, 0], [0, 1000], [1000, 1000]])
    v = (centroids[rng.integers(0, 4, 2000)] + rng.integers(-100, 101, (2000, 2))).astype(np.int32)
    tree, order = kd_clusters.Tree.planted(v, 16)
    assert sorted(order.tolist()) == list(range(2000)) and (tree.vectors == v[order]).all()
    label, counts, sums, whole = tree.filtered(centroids)
    wanted = ((tree.vectors[:, None].astype(int) - centroids[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (label == wanted).all() and counts.tolist() == np.bincount(wanted, minlength=4).tolist()
    assert all((sums[k] == tree.vectors[wanted == k].sum(axis=0)).all() for k in range(4))
    assert whole > 1700  # most rows are never looked at
    same = np.zeros((100, 2), dtype=np.int32)
    label, counts, _, whole = kd_clusters.Tree.planted(same, 4)[0].filtered(np.array([[3, 0], [0, 3], [-3, 0]]))
    assert whole == 0 and set(label) == {0} and counts.tolist() == [100, 0, 0]
