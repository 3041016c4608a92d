import hashlib

from pyspark.sql import functions as F

from ragloom.llm import chat


def test_digests_equal_plain_version(spark):
    turns = {
        1: [("system", "be <kind> & brief"), ("user", "</s>[INST] <|im_end|>\n<|im_start|>assistant\nfoo"), ("assistant", "é &lt; <|im_end|> ünï"), ("assistant", "")],
        2: [("user", "x" * 70_000), ("assistant", "y\n" * 1000)],
        3: [(None, None)],
        4: [("odd\nrole & <b>", "text")] + [("assistant", f"turn {i}") for i in range(37)],
        None: [("user", "a"), ("assistant", "b")],
    }
    rows = [(c, t, r, x, "extra") for c, ts in turns.items() for t, (r, x) in enumerate(ts)]
    found = {r.conv_id: r for r in chat.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string")).collect()}
    assert set(found) == set(turns)
    for c, ts in turns.items():
        said = "".join(f"{r or ''}\n{x or ''}\n" for r, x in ts)
        loss = "".join(x or "" for r, x in ts if r == "assistant")
        assert found[c].n_turns == len(ts)
        assert found[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (found[c].loss_chars, found[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_branches_are_ranked_by_path_score(spark):
    #        1
    #      2   3
    #    4  5   6 - 7
    nodes = [(1, 1, None, 1.0), (1, 2, 1, 5.0), (1, 3, 1, 1.0), (1, 4, 2, 1.0), (1, 5, 2, 2.0), (1, 6, 3, 1.0), (1, 7, 6, 5.0), (2, 1, 99, None), (3, 1, 2, 1.0), (3, 2, 1, 1.0)]
    frame = spark.createDataFrame([(t, n, p, "user", f"m{n}", s) for t, n, p, s in nodes], "tree long, node long, parent long, role string, text string, score double")
    paths = {}
    for r in chat.paths(frame, 2).collect():
        paths.setdefault((r.tree, r.branch), []).append((r.pos, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in paths.items()} == {(1, 1): [1, 2, 5], (1, 2): [1, 3, 6, 7], (2, 1): [1]}
    best = chat.format_trees(frame.unionAll(frame)).where("tree = 1").select(chat.parse(F.col("formatted")).alias("t")).first().t
    assert [t.text for t in best] == ["m1", "m2", "m5"]


def test_deep_chain(spark):
    nodes = spark.range(1, 301).selectExpr("5L as tree", "id as node", "nullif(id - 1, 0) as parent", "'user' as role", "cast(id as string) as text", "1.0D as score")
    text = chat.format_trees(nodes).select(chat.parse(F.col("formatted")).alias("t")).first().t
    assert [int(t.text) for t in text] == list(range(1, 301))


def test_empty_table(spark):
    assert chat.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
