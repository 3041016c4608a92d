import itertools
import random
import zlib

import numpy as np
import pytest

from ragloom.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None,
    "",
    "Hello, World. it's <|endoftext|> x.",
    "É été\x1cline\x85two three éa. ﬁ",
    "one two " * 9000,
    "Thinor. thinor, THINOR thinor).",
    "same text",
    "same text",
]


def whole_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in TEXTS]


def test_pieces_are_the_ids_and_sequences_are_gapless(spark):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(TEXTS)] + [(None, "null id", "z")], "doc_id long, text string, rank string")
    rows = packing.pack(docs, PATH, with_ids=True).collect()
    ids = whole_ids()
    at = {i: 0 for i in range(len(TEXTS))}
    for r in sorted((r for r in rows if r.doc_id is not None), key=lambda r: (r.doc_id, r.start)):
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id]) and list(r.ids) == part
        assert r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
        at[r.doc_id] += r.length
    assert at == {i: len(x) for i, x in enumerate(ids)}
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        end = 0
        for r in group:
            assert r.offset == end
            end += r.length
        assert end <= packing.WINDOW


def best_sum(stock, room, fits):
    sums = {0}
    for length, count in stock:
        sums = {s + k * length for s in sums for k in range(count + 1) if s + k * length <= room}
    return next((f for f in fits if f in sums), max(sums))


def test_fill_is_the_best_there_is():
    rng = random.Random(2)
    for _ in range(200):
        room = rng.randint(0, 60)
        stock = [(k, rng.randint(1, 4)) for k in rng.sample(range(1, 40), 5)]
        fits = [room, *rng.sample(range(room + 1), min(3, room + 1))]
        used = packing.best_fill(stock, room, fits)
        assert all(0 < n <= dict(stock)[k] for k, n in used.items())
        assert sum(k * n for k, n in used.items()) == best_sum(stock, room, fits)


ZIPF = {k: max(1, int(2_000_000 / k**1.3)) for k in range(1, 2048)}
#: Mostly pieces over a third of a window, of few lengths: no packing of these is free of padding.
COARSE = {k: random.Random(k).randint(1, 500) for k in random.Random(4).sample(range(1, 2048), 900)}


@pytest.mark.parametrize(("counts", "share"), [(ZIPF, 0.0001), (COARSE, 0.02)])
def test_plan_uses_up_the_stock_with_little_padding(counts, share):
    left, pad, total = dict(counts), 0, 0
    for times, used in packing.plan(counts):
        fill = sum(k * n for k, n in used)
        assert fill <= 2048
        pad += times * packing.padding(fill)
        total += times * fill
        for k, n in used:
            left[k] -= times * n
    assert not any(left.values()) and pad < share * total


def test_word_store_overflow_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "WORD_STORE", 3)
    with open(PATH, encoding="utf-8") as f:
        encoder = packing.WordEncoder(f.read())
    for _ in range(3):
        for text, ids in zip(TEXTS, whole_ids()):
            assert np.frombuffer(encoder.encode([(text or "").encode()])[0], dtype="<u4").tolist() == ids[:-1]


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
