"""Budgets and training rows against greedy loops, with given counts and with a real tokenizer."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ragloom.operators import budget, replay


def contexts(seed, keys=25):
    rng = random.Random(seed)
    return [(k, i, rng.randint(0, 60), float(rng.randint(0, 5)), rng.random() < 0.2, rng.choice([-1, 0, 50, 120])) for k in range(keys) for i in range(rng.randint(1, 9))]


def taken(rows, slack, strict):
    """One key's contexts in the order in which they are taken."""
    target = rows[0][5] if rows[0][5] >= 0 else 100
    left, used = target + slack, [r[1] for r in rows if r[4]]
    for r in sorted(rows, key=lambda r: (r[3], r[1])):
        if strict and r[2] > left:
            break
        left -= r[2]
        if r[1] not in used:
            used.append(r[1])
        if left < 0:
            break
    return used


@pytest.mark.parametrize("order,strict", [("original", False), ("ranked", True), ("two_stage", False)])
def test_context_budget_equals_a_loop(spark, order, strict):
    rows = contexts(3)
    target = {k: t for k, *_, t in rows}
    rows = [(*r[:5], target[r[0]]) for r in rows]
    df = spark.createDataFrame([(*r, "kept") for r in rows], "key int, i int, tokens int, value double, f boolean, t int, nth string")
    got = {}
    for r in budget.context_budget(df, F.col("t"), slack=20, forced=F.col("f"), order=order, ratio=0.4, strict=strict).collect():
        got.setdefault(r.key, {})[r.out] = (r.i, pytest.approx(r.ratio))
        assert r.nth == "kept"
    for k in target:
        used = taken([r for r in rows if r[0] == k], 20, strict)
        n = len(used)
        ratio = {i: (n - 1 - 2 * p) * 0.4 / (n - 1) if n > 1 else 0.0 for p, i in enumerate(used)}
        if order == "original":
            used = sorted(used)
        elif order == "two_stage":
            used = used[::2] + used[1::2][::-1]
        assert got.get(k, {}) == {p: (i, ratio[i]) for p, i in enumerate(used, 1)}


@pytest.mark.parametrize("strict", [False, True])
def test_sentence_budget_equals_a_loop(spark, strict):
    rng = random.Random(5)
    rows = [(k, i, s, rng.randint(1, 30), float(rng.randint(0, 9))) for k in range(25) for i in range(rng.randint(1, 4)) for s in range(rng.randint(1, 6))]
    df = spark.createDataFrame(rows, "key int, i int, s int, tokens int, value double")
    got = {}
    for r in budget.sentence_budget(df, 40, keep_first=1, keep_last=1, keep_each=1, strict=strict).collect():
        got.setdefault(r.key, set()).add((r.i, r.s))
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        worth = [r[4] for r in own]
        forced = {0, len(own) - 1}
        worth[0] += 100
        worth[-1] += 100
        for i in {r[1] for r in own}:
            best = min((n for n, r in enumerate(own) if r[1] == i), key=lambda n: (worth[n], n))
            forced.add(best)
        worth = [w + 100 * any(n == min((m for m, x in enumerate(own) if x[1] == own[n][1]), key=lambda m: (worth[m], m)) for _ in (0,)) for n, w in enumerate(worth)]
        left, kept = 40 * 1.4, set(forced) if strict else set()
        for n in sorted(range(len(own)), key=lambda n: (-worth[n], n)):
            if strict and own[n][3] > left:
                break
            left -= own[n][3]
            kept.add(n)
            if left < 0:
                break
        if len(own) == 1:
            kept = {0}
        assert got.get(k, set()) == {own[n][1:3] for n in kept}


def test_sft_rows_by_a_real_tokenizer(spark):
    path = public_tokenizers.path("word_bpe_49k.json")

    def word_tokenizer():
        tokenizer = Tokenizer.from_file(path)
        return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    rng = random.Random(7)
    words = "alpha beta gamma delta running quickly internationalization of the a".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, "Read:", f"Question: {text(3)}", text(rng.randint(1, 20)) if k % 7 else "", "x") for k in range(40)] + [(90, "Read:", text(80), "late", "x"), (91, "h", "t", None, "x")]
    passages = [(k, r, text(rng.randint(0, 15)), "y") for k, *_ in items for r in range(1, rng.randint(1, 9))]
    most, top_k = 60, 5
    encode = budget.encoder(word_tokenizer)
    df = spark.createDataFrame(items, "key int, head string, tail string, answer string, rank string")
    got = {r.key: r for r in budget.sft_rows(df, spark.createDataFrame(passages, "key int, rank int, text string, head string"), encode, most, top_k).collect()}
    own_tokenizer = word_tokenizer()
    ids = lambda t: own_tokenizer([t or ""])[0]
    left = {r.key: r.reason for r in budget.left_out(df, encode, most).collect()}
    for k, head, tail, answer, _ in items:
        own = [t for key, r, t, _ in sorted(passages, key=lambda p: p[1]) if key == k and r <= top_k]
        n = len(own)
        build = lambda n: ids(head) + [x for t in own[:n] for x in ids(t)] + ids(tail)  # noqa: B023, E731
        while n and len(build(n)) + len(ids(answer)) > most:
            n -= 1
        if not ids(answer) or len(build(n)) + len(ids(answer)) > most:
            assert k not in got and left[k] == ("no answer" if not ids(answer) else "too long")
            continue
        r = got.pop(k)
        assert k not in left and len(r.input_ids) <= most
        assert (r.input_ids, r.prompt_length, r.n_passages, r.n_dropped) == (build(n) + ids(answer), len(build(n)), n, len(own) - n)
        assert r.labels == [-100] * len(build(n)) + ids(answer)
    assert not got


def test_anchor_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x y z"), (2, "a", "x"), (3, "a", " "), (4, "a", None), (5, "a b c d", "x y z v w u t s")], "key int, prompt string, answer string")
    encode = lambda c: F.transform(F.split(c, " "), lambda w: F.ascii(w))
    got = {r.key: ("".join(map(chr, r.input_ids)), [x for x in r.labels if x != -100]) for r in budget.anchor_rows(df, encode, 4, 5).collect()}
    assert got == {1: ("abcdefxyz", [ord(c) for c in "efxyz"]), 2: ("ax", [ord("x")]), 5: ("abcdxyzvw", [ord(c) for c in "xyzvw"])}


def test_draws_are_exact_and_the_same_under_other_partitions(spark):
    rows = spark.range(50).select((F.col("id") * 3).alias("key"), F.lit("x").alias("number"))
    found = [sorted((r.key, r.copies) for r in replay.drawn(rows.repartition(n), 20_000, 4, "key").collect()) for n in (1, 6)]
    assert found[0] == found[1] and sum(c for _, c in found[0]) == 20_000
    expected = 400
    chi = sum((c - expected) ** 2 / expected for _, c in found[0]) + expected * (50 - len(found[0]))
    assert chi < 90  # 49 degrees of freedom: over 90 once in 3,000 times
    assert replay.drawn(rows, 100, 5, "key").collect() != replay.drawn(rows, 100, 6, "key").collect()
    assert replay.drawn(rows.limit(0), 10, 1, "key").collect() == []


def test_replay_mix(spark):
    explore, old = spark.range(30).select(F.col("id").alias("key")), spark.range(1000, 1010).select(F.col("id").alias("key"))
    got = replay.replay_mix(explore, old, 40, 10, 0.35, seed=1).collect()
    assert len(got) == 400 and {(r.batch, r.slot) for r in got} == {(b, s) for b in range(40) for s in range(10)}
    assert all((r.kind == "replay") == (r.slot >= 7) == (r.key >= 1000) for r in got) and len({r.key for r in got}) == 40
    assert {r.kind for r in replay.replay_mix(explore, old.limit(0), 2, 5, 0.5, seed=1).collect()} == {"explore"}
    with pytest.raises(ValueError):
        replay.replay_mix(explore.limit(0), old, 1, 5, 0.5, seed=1)
