import math
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ragloom.llm import simhash


def plain_simhash(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(items, linked):
    parent = {i: i for i in items}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in items:
        for b in items:
            if linked(a, b):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in items}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbÉ \t\n\x0b\x85 .", max_size=60))
def test_fingerprint_equals_plain_version(text):
    assert simhash.simhash_bytes(text.encode()) == plain_simhash(text)


def test_long_text_is_hashed_in_chunks_to_the_same_value(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000))
    whole = simhash.simhash_bytes(text.encode())
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.simhash_bytes(text.encode()) == whole == plain_simhash(text)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=25, unique=True), st.integers(0, 2))
def test_bk_tree_finds_exactly_what_is_near(values, radius):
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values + [0, 2**64 - 1]:
        assert sorted(tree.values[n] for n in tree.within(q, radius)) == sorted(v for v in values if (v ^ q).bit_count() <= radius)


def test_masks_leave_sixteen_bits_free():
    masks = simhash.shard_masks()
    assert len(masks) == 28 and {m.bit_count() for m in masks} == {48}


def test_links_give_the_components_of_brute_force(spark):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:40]:
        for _ in range(3):
            for _ in range(rng.randint(1, 2)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    signed = sorted(simhash._as_long(p) for p in prints)
    wanted = classes(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    found = {r.node: r.root for r in simhash.components(simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long"))).collect()}
    assert {p: found.get(p, p) for p in signed} == wanted


def test_chain_of_links_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    found = simhash.components(links).collect()
    assert len(found) == 201 and {r.root for r in found} == {0}


DOCS = [
    (7, "the quick brown fox jumps over the lazy dog", "x"),
    (3, "THE quick brown fox jumps over the lazy dog", "y"),
    (3, "THE quick brown fox jumps over the lazy dog", "y"),
    (9, None, None),
    (8, "", "z"),
    (10, " \t\n", "z"),
    (None, "the quick brown fox jumps over the lazy dog", None),
    (11, "word " * 3000 + "end", "w"),
    (12, "one two", "w"),
]


def test_edge_rows(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, fingerprint string")
    rows = sorted(simhash.near_duplicates(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert len(rows) == len(DOCS)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[9].fingerprint == by_id[8].fingerprint == by_id[10].fingerprint == "0" * 16
    assert {by_id[i].component_id for i in (8, 9, 10)} == {8}
    assert {by_id[i].component_id for i in (3, 7, None)} == {3}
    for doc_id, text, _ in DOCS:
        assert by_id[doc_id].fingerprint == f"{plain_simhash(text):016x}"


def test_stage_keeps_one_of_each(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, keeper string")
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x)) == [3, 8, 10, 11, 12]  # white space alone differs from no text; the row without an id is a copy of 3


def test_texts_that_share_an_id_stay_apart(spark):
    a, b, c = ("first text of one id", "another text of the same id", "a text without an id")
    rows = [(5, a, "x"), (5, b, "y"), (7, b, "z"), (None, c, "n"), (None, c, "m"), (None, a, "n"), (5, a, "w"), (9, None, "q"), (9, "", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keeper string")
    assert sorted(map(tuple, simhash.keep_one_of_each(docs).collect()), key=str) == sorted([(5, a, "w"), (5, b, "y"), (None, c, "m"), (9, "", "r")], key=str)
    named = sorted(((r.doc_id, r.class_id) for r in simhash.near_copies(docs).collect()), key=str)
    assert named == sorted([(5, 5)] * 3 + [(7, 5), (None, None), (None, None), (None, 5), (9, 9), (9, 9)], key=str)


def test_a_true_link_beside_a_nearer_false_one(spark):
    """Of three texts, the middle one is nearest to a text that it isn't similar enough to."""
    rng = random.Random(12)
    texts = []
    for f in range(30):
        base = [f"f{f}w{i}" for i in range(300)]
        for changes in (0, 5, 6, 7, 8):  # similarities from below 0.8 to above it between them
            copy = list(base)
            for k in rng.sample(range(10, 290), changes):
                copy[k] = f"x{rng.random()}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    wanted = brute_classes(texts)
    assert found_classes(spark, texts) == wanted and 30 < len(set(wanted.values())) < 150


def test_word_hashes_know_words():
    texts = [b"One two  THREE\tfour\x0bfive six", b"", b" \n", b"x", "gr\u00fc\u00df dich \u00a0 a\u2003b".encode(), b"w" * (1 << 21) + b" end"]
    for t in texts:
        words = t.lower().split()
        assert len(simhash.word_hashes(t)) == len(words)
        assert (simhash.word_hashes(t) == np.concatenate([np.zeros(0, np.uint64), *(simhash.word_hashes(w) for w in words)])).all()
    assert [len(s) for s in simhash.shingle_sets(texts, 5)] == [2, 0, 0, 1, 1, 1]
    assert all((a == simhash.shingle_sets([t], 5)[0]).all() for a, t in zip(simhash.shingle_sets(texts, 5), texts))


def test_decisions_of_groups_equal_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(1, 1 << 40, 60)
    sets = [np.unique(np.concatenate((rng.permutation(base)[: rng.integers(45, 60)], rng.integers(1, 1 << 40, rng.integers(0, 6))))) for _ in range(40)]
    for side in (np.zeros(40, dtype=int), np.arange(40) % 7 == 0):
        roots = np.arange(40) // 2 * 2
        links = simhash.verified_links(roots, np.asarray(side, dtype=int), sets, 0.8)

        def alike(i, j):
            both = len(np.intersect1d(sets[i], sets[j]))
            return both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)

        pairs = [(i, j) for i in range(40) for j in range(i) if len(set(side)) == 1 or side[i] != side[j]]
        wanted = classes(list(range(40)), lambda i, j: roots[i] == roots[j] or ((i, j) in pairs or (j, i) in pairs) and alike(i, j))
        got = classes(list(range(40)), lambda i, j: roots[i] == roots[j] or (roots[i], roots[j]) in links or (roots[j], roots[i]) in links)
        assert got == wanted


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(40):
        base = rng.choices(words, k=rng.randint(60, 400))
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(copy) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += [texts[0], texts[0].upper(), "one two three", "one  two three", "", " ", "\t"]
    sets = {}
    for i, t in enumerate(texts):
        w = t.lower().split()
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    def linked(a, b):
        union = len(sets[a] | sets[b])
        return texts[a] == texts[b] or (union > 0 and len(sets[a] & sets[b]) / union >= 0.8)

    wanted = classes(list(sets), linked)
    found = {r.doc_id: r.class_id for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == wanted and len(set(wanted.values())) < len(texts) - 10


def test_large_shards_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_BLOCK", 3)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(25):
        copy = list(base)
        copy[10 * i % 300] = f"x{i}"
        texts.append(" ".join(copy))
    found = simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(found) == 25 and {r.class_id for r in found} == {0}


def shingle_set(text):
    w = text.lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_classes(texts):
    sets = {i: shingle_set(t) for i, t in enumerate(texts)}
    return classes(list(sets), lambda a, b: texts[a] == texts[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0)


def found_classes(spark, texts):
    return {r.doc_id: r.class_id for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


@pytest.mark.parametrize("block", [2048, 5])
def test_classes_merge_on_verified_pairs_at_the_edge(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "SHARD_BLOCK", block)
    rng = random.Random(4)
    texts = []
    for f in range(12):
        base = [f"f{f}w{i}" for i in range(230)]
        for _ in range(14):
            copy = list(base)
            for k in rng.sample(range(230), 3 + f % 3):
                copy[k] = f"x{rng.random()}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    assert found_classes(spark, texts) == brute_classes(texts)


def test_equal_fingerprints_are_no_similarity(spark):
    line = "the same line comes again and again " * 400
    body = [f"b{i}" for i in range(100)]
    texts = ["a " + line] + [line + " ".join([*body, f"y{i}"]) for i in range(3)] + [line + " ".join(f"c{i}" for i in range(100))]
    wanted = brute_classes(texts)
    assert found_classes(spark, texts) == wanted and len(set(wanted.values())) == 3


def test_repeated_lines_and_short_texts_are_found(spark):
    body = " ".join(f"b{i}" for i in range(200))
    footer = " all rights reserved by the owner of this page"
    texts = [body + footer, body + footer * 300, "short " + body]
    rng = random.Random(8)
    for i in range(300):  # eight words against nine: four shingles of five
        words = [f"s{i}v{rng.random()}" for _ in range(9)]
        texts += [" ".join(words), " ".join(words[:8])]
    wanted = brute_classes(texts)
    assert found_classes(spark, texts) == wanted and len(set(wanted.values())) == 301


def test_chance_of_a_missed_pair_is_as_stated():
    def tail(p):
        return sum(math.comb(256, k) * p**k * (1 - p) ** (256 - k) for k in range(simhash.COPY_RADIUS + 1, 257))

    assert tail(0.1875) < 1 / 1.8e6 and tail(math.acos(8 / 9) / math.pi) < 1e-10


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.keep_one_of_each(docs).collect() == []


def test_radius_is_bounded(spark):
    with pytest.raises(ValueError):
        simhash.fingerprint_links(spark.createDataFrame([], "fp long"), 3)


@pytest.mark.parametrize("n, sides", [(1, 1), (9, 1), (40, 2), (600, 1), (600, 2)])
def test_groups_are_searched_along_trees(monkeypatch, n, sides):
    """Candidates of a shard equal those of all pairs, and branches beyond the radius are left out."""
    rng = np.random.default_rng(n + sides)
    fp = rng.integers(0, 1 << 63, (3, simhash.WORDS), dtype=np.uint64)[rng.integers(0, 3, n)]
    fp[np.arange(n), rng.integers(0, simhash.WORDS, n)] ^= np.uint64(1) << rng.integers(0, 63, n).astype(np.uint64)
    m = {"fp": fp, "side": np.arange(n) % sides, "size": rng.integers(90, 130, n), "root": rng.integers(0, n, n)}
    apart = lambda i, j: int(np.bitwise_count(fp[i] ^ fp[j]).sum())
    both = [(i, j) for i in range(n) for j in range(n) if (j < i if sides == 1 else (m["side"][i], m["side"][j]) == (0, 1))]
    alike = lambda i, j: min(m["size"][i], m["size"][j]) >= 0.8 * max(m["size"][i], m["size"][j]) - 1e-9
    wanted = [(i, j) for i, j in both if m["root"][i] != m["root"][j] and alike(i, j) and apart(i, j) <= 20]
    walked = []
    if n > 2 * simhash.TREE_ROWS:
        count = simhash._apart
        monkeypatch.setattr(simhash, "_apart", lambda words, some, node: walked.append(len(some)) or count(words, some, node))
    else:
        within = simhash.BKTree.within
        monkeypatch.setattr(simhash.BKTree, "within", lambda tree, value, radius: walked.append(len(tree.values)) or within(tree, value, radius))
    found, pairs = simhash.undecided(m, 20, 0.8)
    assert walked  # a tree was asked
    assert n < 600 or sum(walked) < len(both)
    assert found.tolist() == sorted({i for pair in wanted for i in pair})
    assert pairs is None if len(wanted) > simhash.PAIRS_EACH * n else [tuple(x) for x in pairs.tolist()] == wanted
