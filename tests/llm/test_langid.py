import zlib

import numpy as np

from ragloom.llm import langid

WORDS = {"aa": "the and of ing tion that with".split(), "bb": "und der die ein ich schön über".split(), "cc": "que les des eau été où".split()}


def make(n=90):
    rng = np.random.default_rng(3)
    langs = list(WORDS)
    return [(i, " ".join(rng.choice(WORDS[langs[i % 3]], 30)), langs[i % 3]) for i in range(n)]


def test_held_out_accuracy_and_fold(spark):
    docs = spark.createDataFrame([(i, t, lang, 0.5) for i, t, lang in make()], "doc_id long, text string, lang string, score double")
    rows = langid.identify(docs).collect()
    wanted = {i: lang for i, _, lang in make()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.lang_pred == wanted[r.doc_id] and 0 <= r.score <= 1 for r in rows)


def test_edge_rows_and_stage(spark):
    extra = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 ... !?", "bb"), (None, "the and of ing tion", None), (1003, "the and " * 400_000, "aa"), (1003, "the and", "aa"), (1003, "the and", "aa")]
    docs = spark.createDataFrame(make() + extra, "doc_id long, text string, lang string")
    rows = langid.identify(docs).collect()
    assert len(rows) == 90 + len(extra)
    assert {r.lang_pred for r in rows if r.doc_id in (1000, 1001, 1002)} == {"und"}
    assert {(r.lang_pred, r.held_out) for r in rows if r.doc_id is None} == {("aa", False)}
    assert {r.lang_pred for r in rows if r.doc_id == 1003} == {"aa"}
    kept = langid.keep_identified(docs.withColumnRenamed("lang", "lang"))
    assert kept.columns == docs.columns and kept.count() == 90 + 4


def test_prediction_does_not_read_the_label(spark):
    plain = spark.createDataFrame(make(), "doc_id long, text string, lang string")
    held = [i for i, _, _ in make() if zlib.crc32(str(i).encode()) % 5 == 0]
    other = spark.createDataFrame([(i, t, "zz" if i in held else lang) for i, t, lang in make()], "doc_id long, text string, lang string")
    assert sorted(langid.identify(plain).collect()) == sorted(langid.identify(other).collect())


def test_nothing_learned_and_empty(spark):
    docs = spark.createDataFrame([(1, "the and", None)], "doc_id long, text string, lang string")
    assert langid.identify(docs).first().lang_pred == "und"
    assert langid.identify(docs.limit(0)).collect() == []


def test_chunks_do_not_change_the_vector(monkeypatch):
    text = "The und  ..  où été 12 über " * 9
    whole, size = langid.bundle(text)
    monkeypatch.setattr(langid, "CHUNK", 5)
    again, again_size = langid.bundle(text)
    assert np.array_equal(again, whole) and size == again_size


def test_bundle_is_the_sum_of_bound_letters():
    letters = np.random.default_rng(langid.SEED).choice(np.array([-1, 1], dtype=np.int8), size=(langid.SYMBOLS, langid.DIMENSIONS)).astype(int)
    codes = [0, 1, 2, 0]
    wanted = sum(np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c] for a, b, c in zip(codes, codes[1:], codes[2:]))
    assert np.array_equal(langid.bundle("ab")[0], wanted)


def test_letters_beyond_the_table_are_told_apart(spark):
    words = {"ru": "который было только сказал время была этого человек есть если".split(), "bg": "която беше само каза време имаше този човек има ако".split()}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(words[lang], 12)), lang) for i in range(80) for lang in [("ru", "bg")[i % 2]]]
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r.lang_pred == ("ru", "bg")[r.doc_id % 2] for r in found)


def test_stage_rejects_languages_that_were_not_learned(spark):
    other = ["мама мыла раму и потом пошла домой через лес " * 5, "人人生而自由在尊严和权利上一律平等 " * 9, "kjqx zvwpk qqzx vvkj xjqz pkwv " * 9]
    rows = make() + [(500 + i, t, None) for i, t in enumerate(other)] + [(600, "и лес", None), (601, "que les des eau " * 9, None)]
    kept = langid.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted(r.doc_id for r in kept) == [*range(90), 600, 601]  # too short to be told from chance: stays


def test_more_languages_than_a_task_holds(spark, monkeypatch):
    rows = make()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    whole = langid.train(docs)
    monkeypatch.setattr(langid, "HELD", 1)
    some = langid.train(docs)
    assert whole.keys() == some.keys() and all(np.array_equal(whole[k], some[k]) for k in whole)
