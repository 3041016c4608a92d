import numpy as np
import pytest

from ragloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, q, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != q]
    return [(int(ids[i]), d[i]) for i in order[:k]]


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2500, 32)).astype(np.float32)
    rows = [(i, x[i].tolist()) for i in range(2500)]
    found = {}
    for r in ann.neighbours(spark.createDataFrame([(i, v, "s") for i, v in rows], SCHEMA)).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in range(0, 2500, 100):
        got, wanted = sorted(found[q]), brute(rows, q)
        assert [r for r, _, _ in got] == list(range(1, 11))
        assert [s for *_, s in got] == sorted(s for *_, s in got)
        exact = dict(brute(rows, q, 2499))
        assert all(s == pytest.approx(exact[i], abs=1e-12) for _, i, s in got)
        hits += len({i for _, i, _ in got} & {i for i, _ in wanted})
    assert hits >= 0.9 * 250


def test_blocks_are_bounded_by_bytes_and_change_no_score(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_BYTES", 8 * 32 * 50)  # 50 rows of 32 dimensions
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 32)).astype(np.float32)
    rows = [(i, x[i].tolist()) for i in range(1500)]
    hits = 0
    found = ann.neighbours(spark.createDataFrame([(i, v, "s") for i, v in rows], SCHEMA)).collect()
    for q in range(0, 1500, 100):
        exact = dict(brute(rows, q, 1499))
        own = [r for r in found if r.query_id == q]
        assert all(r.score == pytest.approx(exact[r.vec_id], abs=1e-12) for r in own) and len(own) == 10
        hits += len({r.vec_id for r in own} & {i for i, _ in brute(rows, q)})
    assert hits >= 0.9 * 150


def test_equal_vectors_tie_to_smaller_ids(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(400)] + [(i, [float(i), 1.0, 0.0]) for i in range(401, 431)]
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.neighbours(spark.createDataFrame([(i, v, "s") for i, v in rows], SCHEMA)).collect())
    assert [x for x in found if x[0] == 0] == [(0, k, k, 0.0) for k in range(1, 11)]
    assert [x[2] for x in found if x[0] == 100] == list(range(10))


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, None), (200, [0.0, 0.0]), (300, [1.0, None]), (400, [nan, 1.0]), (500, [inf, 1.0]), (600, []), (None, [1.0, 1.0]), (7, [0.0, 1.0]), (8, [1.0, 1.0]), (8, [1.0, 1.0]), (700, [1.0, 2.0, 3.0])]
    found = sorted((r.query_id, r.rank, r.vec_id) for r in ann.neighbours(spark.createDataFrame([(i, v, "s") for i, v in rows], SCHEMA)).collect())
    assert found == [(0, 1, 8), (0, 2, 7)]


def test_empty_table(spark):
    assert ann.neighbours(spark.createDataFrame([], SCHEMA)).collect() == []
    assert ann.neighbours(spark.createDataFrame([(1, [1.0], "s")], SCHEMA)).collect() == []


def test_footrule_equals_plain_version():
    rng = np.random.default_rng(2)
    orders = np.array([rng.permutation(12)[:5] for _ in range(40)])
    files = ann.PivotFiles(orders, 12)
    for q in orders[:5]:
        place = lambda o, p: list(o).index(p) if p in o else 5
        wanted = [sum(abs(place(o, p) - place(q, p)) for p in range(12)) for o in orders]
        assert files.footrule(q).tolist() == wanted
