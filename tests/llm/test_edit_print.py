import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from ragloom.llm import edit_print


def plain_samples(text):
    """One walk, a step at a time."""
    taken, points, i, step = [0] * edit_print.SLOTS, [ord(c) for c in text], 0, 0
    marks = edit_print._sampled_steps()
    while i < len(points):
        for slot in marks.get(step, ()):
            taken[slot] = points[i] + 1
        row = edit_print._bits(step - step % edit_print.STRIDE)[step % edit_print.STRIDE]
        i += int(row[(points[i] * 2654435761 & 0xFFFFFFFF) >> 26])
        step += 1
    return taken


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh éü\n") for _ in range(rng.randint(0, 300))) for _ in range(n)]


def test_walks_equal_plain_version(monkeypatch):
    many = texts(70) + ["", "x", "\U0001f600" * 50]
    wanted = [plain_samples(t) for t in many]
    assert edit_print.samples(many).tolist() == wanted
    monkeypatch.setattr(edit_print, "FEW", 0)
    assert edit_print.samples(many).tolist() == wanted
    monkeypatch.setattr(edit_print, "FEW", 1000)
    monkeypatch.setattr(edit_print, "STORED", 1)
    assert edit_print.samples(many).tolist() == wanted
    assert edit_print.samples([]).shape == (0, edit_print.SLOTS)


def test_likeness_falls_with_edits():
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefghijklmnop") for _ in range(4000))
    near = base[:1000] + "XY" + base[1003:2500] + base[2504:]
    other = "".join(rng.choice("abcdefghijklmnop") for _ in range(4000))
    p = edit_print.prints_of([base, near, other])
    assert (p[0] == p[1]).mean() > 0.75 > 0.4 > (p[0] == p[2]).mean()


def test_query_equals_plain_version(spark):
    rows = list(enumerate(texts(60))) + [(500, None), (501, ""), (502, "tail " * 30_000)]
    docs = spark.createDataFrame([(i * 3, t, "f") for i, t in rows], "doc_id long, text string, fingerprint string").repartition(5)
    found = {r.doc_id: r for r in edit_print.compare(docs, buckets=7).collect()}
    assert len(found) == len(rows)
    ordered = sorted((i * 3, t or "") for i, t in rows)
    prints = dict(zip((i for i, _ in ordered), edit_print.digits(edit_print.prints_of([t for _, t in ordered]))))
    like = lambda a, b: float(np.mean([x == y for x, y in zip(a, b)]))
    for k, (i, text) in enumerate(ordered):
        j, after = ordered[(k + 1) % len(ordered)]
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        row = found[i]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert row.fingerprint == prints[i] and row.near_next == like(prints[i], prints[j])
        assert row.near_edited == like(row.fingerprint, row.edited_fingerprint)


def test_batches_do_not_change_the_result(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(texts(40))), "doc_id long, text string")
    whole = sorted(edit_print.compare(docs, buckets=2).collect())
    monkeypatch.setattr(edit_print, "BATCH", 100)
    assert sorted(edit_print.compare(docs, buckets=2).collect()) == whole


def test_nulls_repeats_and_small_tables(spark):
    docs = spark.createDataFrame([(None, "b"), (None, "a"), (4, "same"), (4, "same"), (4, "other")], "doc_id long, text string")
    rows = edit_print.compare(docs).collect()
    assert len(rows) == 5 and sorted(r.n_chars for r in rows) == [1, 1, 4, 4, 5]
    one = edit_print.compare(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0
    assert edit_print.compare(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_majority_without_an_id_is_spread(spark):
    many = [t for t in texts(120, seed=5) if t]
    docs = spark.createDataFrame([(None, t) for t in many] + [(7, "seven"), (3, "three")], "doc_id long, text string")
    rows = edit_print.compare(docs, buckets=6).collect()
    assert len(rows) == len(many) + 2 and sorted(r.n_chars for r in rows if r.doc_id is None) == sorted(map(len, many))
    parts = edit_print.in_order(docs, buckets=6).where("doc_id is null and not extra").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 6 and max(r["count"] for r in parts) < len(many) / 2
    # Every document but one is followed by another one, so each text's start ends one other's edited text.
    print_of = {r.fingerprint for r in rows}
    assert {edit_print.digits(edit_print.prints_of([t]))[0] for t in many} <= print_of


def test_recall_of_banding(spark):
    """Pairs whose fingerprints agree in 0.8 of the digits and more are put into one class; documents without such a partner stay alone."""
    rng = random.Random(9)
    rows = []
    for i in range(150):
        base = [rng.choice("abcdefghijklmnop ") for _ in range(800)]
        rows.append((10 * i, "".join(base)))
        for j in range(1, 3):
            near = list(base)
            for _ in range(rng.randint(1, 30)):
                near[rng.randrange(len(near))] = rng.choice("xyz")
            rows.append((10 * i + j, "".join(near)))
    prints = edit_print.prints_of([t for _, t in rows])
    pairs = [(rows[a][0], rows[b][0]) for a in range(len(rows)) for b in range(a) if (prints[a] == prints[b]).mean() >= 0.8]
    near = edit_print.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), 0.8)
    found = {r.doc_id: r.class_id for r in near.collect()}
    assert len(pairs) > 100 and sum(found[a] == found[b] for a, b in pairs) >= 0.995 * len(pairs)
    linked = {x for p in pairs for x in p}
    assert all(found[i] == i for i, _ in rows if i not in linked)


def test_near_pairs(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefghijklmnop") for _ in range(1500)) for _ in range(30)]
    rows = [(i, t, "x") for i, t in enumerate(base)] + [(100 + i, t[:700] + "Z" + t[701:], "x") for i, t in enumerate(base[:10])] + [(200, base[0], "x"), (201, base[0], "x"), (300, None, "x")]
    classes = edit_print.near_classes(spark.createDataFrame(rows, "doc_id long, text string, fp string"), 0.8)
    found = {r.doc_id: r.class_id for r in classes.collect()}
    assert len(found) == len(rows)
    assert all(found[100 + i] == i for i in range(10)) and found[200] == found[201] == 0
    assert all(found[i] == i for i in range(30)) and found[300] == 300
