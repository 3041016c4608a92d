import re
from collections import defaultdict

import pytest

from ragloom.llm import mixing


def fill(sizes, share=1.5, cap=2.0):
    """Targets by resharing the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        goal = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if goal[s] > cap * sizes[s]]
        if not over:
            return {**fixed, **goal}
        fixed.update({s: cap * sizes[s] for s in over})


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, mix_key string")


def make():
    rows = [(i, "w " * (1 + i * 7 % 40), "hot" if i % 3 == 0 else f"s{i % 7}", "k") for i in range(700)]
    return rows + [(None, "a b c", None, None), (900, None, "s1", None), (901, "", "ä", None), (5, "x y", None, None), (5, "x y", None, None)]


def test_mix_meets_targets(spark):
    rows = make()
    out = mixing.mixture(docs_of(spark, rows)).collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for _, text, source, _ in rows:
        sizes[source] += len(re.findall(mixing.WORD, text or ""))
    wanted = fill(sizes)
    full = mixing.copies(docs_of(spark, rows)).collect()
    taken, largest = defaultdict(int), defaultdict(int)
    for r in full:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= 2 * largest[s] + 1e-6


def test_reruns_and_partitions_agree(spark):
    docs = docs_of(spark, make())
    first = sorted(map(str, mixing.mixture(docs).collect()))
    assert first == sorted(map(str, mixing.mixture(docs.repartition(7)).collect()))


def test_copies_are_the_boundaries_crossed(spark):
    rows = sorted(mixing.copies(docs_of(spark, [(i, "one two", "a" if i < 30 else "b", "") for i in range(50)])).where("source = 'b'").collect())
    expected = rows[0].target / rows[0].source_size
    assert abs(sum(r.copies for r in rows) - expected * len(rows)) <= 1
    assert max(r.copies for r in rows) - min(r.copies for r in rows) <= 1


def test_mixed_rows_repeat_documents(spark):
    docs = docs_of(spark, make())
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    count = defaultdict(int)
    for r in mixing.copies(docs).collect():
        count[(r.doc_id, r.source)] += r.copies
    found = defaultdict(int)
    for r in out.collect():
        found[(r.doc_id, r.source)] += 1
    assert {k: v for k, v in count.items() if v} == dict(found)


def test_rows_that_differ_in_another_column_alone(spark):
    rows = [(1, "one two", "a", x) for x in ("p", "q", None, "p")] + [(2, "three", "b", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_key string")
    count = defaultdict(int)
    for r in mixing.mixed_rows(docs).collect():
        count[r.mix_key] += r.doc_id == 1
    taken = sum(r.copies for r in mixing.copies(docs).where("source = 'a'").collect())
    assert sum(count.values()) == taken and set(count) <= {"p", "q", None} and len(count) == 3
    assert sorted(map(str, mixing.mixed_rows(docs).collect())) == sorted(map(str, mixing.mixed_rows(docs.repartition(5)).collect()))


def test_empty_tables(spark):
    docs = docs_of(spark, [])
    assert mixing.mixture(docs).collect() == [] and mixing.mixed_rows(docs).collect() == []
    assert [r.taken for r in mixing.mixture(docs_of(spark, [(1, None, None, None)])).collect()] == [0]
