import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ragloom.llm import fill_middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n string, output string"
TEXTS = [None, "", " ", "a", " a", "a ", "one two  three\tfour\n", "   é 你好 \U0001f600x\x0b\x0cy", "x <P> y", "<S>", "a<M", "a <M", "<", "<P", "P> <S", "\x00 \x1c\x1d a", "ends with <", "\n\n\n", "word " * 3000]


def plain_version(doc_id, text, rate=50, spm_rate=80):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    tokens = TOKEN.findall(text)
    assert "".join(tokens) == text
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows_of(texts=TEXTS, ids=40):
    return [(i, t, "x", "y") for i in range(ids) for t in texts] + [(None, t, None, None) for t in texts]


@pytest.mark.parametrize("rates", [(50, 80), (100, 0), (100, 100)])
@pytest.mark.parametrize("slice_bytes", [1, 37, fill_middle.SLICE])
def test_equals_plain_version_and_reads_back(spark, rates, slice_bytes):
    rows = rows_of(ids=40 if slice_bytes == 37 else 6)
    made = fill_middle.transform(spark.createDataFrame(rows, SCHEMA), *rates, slice_bytes=slice_bytes)
    got = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    found = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got), key=key)
    wanted = sorted(((i, *plain_version(i, t, *rates), t or "") for i, t, *_ in rows), key=key)
    assert found == wanted


def test_all_cuts_of_a_sliced_array():
    texts = pa.array(["skipped", "a b c", "", "é <b> ü ", "last"])[1:]
    for one in range(5):
        for two in range(5):
            h = [np.full(4, one), np.full(4, two), np.zeros(4, dtype=int), np.full(4, 99)]
            for text, x in zip(texts.to_pylist(), fill_middle.spliced(texts, h).to_pylist()):
                tokens = TOKEN.findall(text)
                a, b = sorted((one % (len(tokens) + 1), two % (len(tokens) + 1)))
                p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
                assert x["output"] == (f"<P>{p}<S>{s}<M>{m}" if text else "")


def test_digests_and_empty_table(spark):
    rows = [(7, "to be or not to be", None, None)] * 2
    got = fill_middle.digests(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 2 and got[0] == got[1]
    assert got[0].restored_sha256 == hashlib.sha256(b"to be or not to be").hexdigest()
    assert got[0].output_sha256 == hashlib.sha256(plain_version(7, "to be or not to be")[-1].encode()).hexdigest()
    assert fill_middle.digests(spark.createDataFrame([], SCHEMA)).collect() == []
