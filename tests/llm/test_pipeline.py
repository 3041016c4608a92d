import random
from collections import Counter

import pytest

import corpus_pipeline
from ragloom.llm import mixing

pytest.importorskip("public_tokenizers")

WORDS = {"en": "the and of ing tion that with for was are this".split(), "de": "und der die ein ich über nicht zum eine".split()}


def documents():
    rng = random.Random(6)
    rows = []
    for i in range(60):
        lang = ("en", "de")[i % 2]
        rows.append((i, " ".join(rng.choice(WORDS[lang]) + rng.choice("abcdefgh") for _ in range(rng.randint(20, 120))), lang, f"src{i % 3}", i))
    words = rows[0][1].split()
    words[3] = "changed"
    rows += [(100, rows[0][1], "en", "src0", 1), (101, " ".join(words + ["the"] * 3), "en", "src1", 1)]
    rows += [(200, None, None, None, None), (201, "", "en", "src0", 0), (202, "12 345 !!", "en", "src0", 3), (203, "eine ganz andere und neue kurze zeile mit password: abcdefghijklmnop1234", "de", None, 9)]
    return rows + [rows[7], (None, "the and of this with for", "en", "src2", 5)]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def run(spark, docs, tmp_path):
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(i))
        stage(spark, out[-1], "").write.parquet(path)
        out.append(spark.read.parquet(path))
    return out[1:]


def test_each_stage_takes_effect_on_its_input(spark, tmp_path):
    rows = documents()
    docs = spark.createDataFrame([(*r, "kept") for r in rows], COLUMNS + ", findings string")
    named, single, clean, mixed, packed = run(spark, docs, tmp_path)
    assert all(x.columns == docs.columns for x in (named, single, clean, mixed))
    ids = Counter(r.doc_id for r in named.collect())
    assert ids == Counter(r[0] for r in rows if r[0] not in (200, 201, 202))
    kept = Counter(r.doc_id for r in single.collect())
    assert kept == Counter({i for i in ids if i not in (100, 101)})
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert len(texts) == len(kept) and texts[203].endswith(" [secret]")
    assert all(texts[r[0]] == r[1] for r in rows if r[0] in texts and r[0] != 203)
    wanted = Counter()
    for r in mixing.copies(clean).collect():
        wanted[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: v for k, v in wanted.items() if v})
    tokens = {(r.doc_id, r.start): r.length for r in packed.collect()}
    assert {k for k, _ in tokens} == {r.doc_id for r in mixed.collect()}
    fills = Counter()
    for r in packed.collect():
        fills[r.sequence_id] += r.length
    assert max(fills.values()) <= 2048


def test_long_texts_and_columns_of_any_name(spark, tmp_path):
    names = ["blob", "row", "at", "same", "keeper", "rest", "language", "mix_key", "mix_copies", "pieces", "tail", "fingerprint", "component_id", "size", "node"]
    long = " ".join(f"the and of word{i}" for i in range(40_000)) + " token: abcdefghijklmnopq the end"
    rows = [(1, long, "en", "src0", 1), (2, long, "en", "src0", 1), (3, "und der die ein ich über nicht zum eine gut", "de", "src1", 1), (4, "the and of this with for that are was in", "en", "src1", 1)]
    docs = spark.createDataFrame([(*r, *[f"{n}{r[0]}" for n in names]) for r in rows], ", ".join([COLUMNS, *[f"`{n}` string" for n in names]]))
    *stages, packed = run(spark, docs, tmp_path)
    assert all(x.columns == docs.columns for x in stages)
    assert all(r[n] == f"{n}{r.doc_id}" for x in stages for r in x.collect() for n in names)
    assert {r.doc_id for r in stages[1].collect()} == {1, 3, 4}
    text = next(r.text for r in stages[2].collect() if r.doc_id == 1)
    assert text == long.replace("token: abcdefghijklmnopq", "[secret]")
    assert sum(r.length for r in packed.where("doc_id = 1").collect()) > 160_000 * packed.where("doc_id = 1 and start = 0").count()


def test_empty_documents(spark, tmp_path):
    assert [x.count() for x in run(spark, spark.createDataFrame([], COLUMNS), tmp_path)] == [0] * 5
