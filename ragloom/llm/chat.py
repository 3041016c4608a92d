"""Chat formatting of reply trees, in DataFrame operations only.

A tree's nodes are messages with a parent. Iterative self-joins double the reach of an ancestor pointer each round, so a tree of depth d
takes log2(d) rounds however deep it is; each round also adds up scores and lengths, which gives every leaf the score of
its root-to-leaf path. Branches are ranked by that score within their tree, the best ``branches`` of them are
walked back to the root by halving (again log2(d) joins), and each path is formatted as one conversation.

Template, for each turn: ``<|im_start|>role\\ntext<|im_end|>\\n``. In roles and texts ``&`` and ``<`` are written as ``&amp;`` and
``&lt;`` (in roles also a line feed as ``&#10;``), so no text can hold a control string, and ``parse`` gives back
exactly what went in. The loss mask lists the code point spans of the assistants' texts.

Edge cases: a null text or role is empty; a null tree is a tree of its own; a parent that is not in the tree makes its node a root;
of repeated node ids in a tree the smallest (parent, score, role, text) counts; nodes on a cycle have no root and give no
conversation; ties in score go to the smaller leaf; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragloom.session import cut

# The template's control strings.
START, END = "<|im_start|>", "<|im_end|>\n"
END_PATTERN = r"<\|im_end\|>\n"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit("\n"), F.lit("&#10;")) if role else out


def unescape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("&#10;"), F.lit("\n")) if role else text
    return F.replace(F.replace(out, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def as_trees(conversations: DataFrame) -> DataFrame:
    """Rows by turn as trees of one branch: each row replies to the one before it (ties by role, then text)."""
    turns = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(turns).cast("long"))
    return rows.select(
        F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score")
    )


def paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """``tree``, ``leaf``, ``branch`` (1 is best), ``pos`` (1 is the root), ``node``: the best paths of each tree."""
    links = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = links.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    first = links.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")), "left")
    first = cut(first.select("tree", "node", F.col("n").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("size")))
    # Nodes whose pointer is past the root are ready; only the others are joined again, each time reaching twice as far.
    ready, levels = first.where("up is null"), [first.where("up is not null")]
    rounds = math.ceil(math.log2(first.count() + 2)) + 1
    while len(levels) <= rounds and not levels[-1].isEmpty():
        now = ready.unionByName(levels[-1])
        far = now.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("far"), F.col("total").alias("more"), F.col("size").alias("longer"))
        joined = levels[-1].join(far, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n")))
        grown = cut(joined.select("tree", "node", F.col("far").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("size") + F.col("longer")).alias("size")))
        ready = ready.unionByName(grown.where("up is null"))
        levels.append(grown.where("up is not null"))
    parents = first.where("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("n")).distinct()
    leaves = ready.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti")
    best = Window.partitionBy("tree").orderBy(F.col("total").desc(), F.col("node"))
    chosen = leaves.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches)
    # A piece of a path is its lowest node, the position of that, and how many nodes it has, at most 2^(i+1) before step i.
    pieces = chosen.select("tree", F.col("node").alias("leaf"), "branch", F.col("size").alias("pos"), "node", "size")
    for i in range(len(levels) - 2, -1, -1):
        half = F.lit(1 << i).cast("long")
        jumps = levels[i].select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        joined = pieces.join(jumps, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")) & (F.col("size") > half), "left")
        low = F.struct("pos", "node", F.least("size", half).alias("size"))
        high = F.struct((F.col("pos") - half).alias("pos"), F.col("up").alias("node"), (F.col("size") - half).alias("size"))
        split = F.when(F.col("size") > half, F.array(low, high)).otherwise(F.array(low))
        pieces = joined.select("tree", "leaf", "branch", F.explode(split).alias("x")).select("tree", "leaf", "branch", "x.*")
    return pieces.select("tree", "leaf", "branch", "pos", "node")


def format_trees(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """``tree``, ``leaf``, ``branch``, ``formatted`` and ``loss_mask`` (spans of code points, end exclusive)."""
    one = nodes.groupBy("tree", "node").agg(F.min(F.struct("parent", "score", "role", "text")).alias("x")).select("tree", "node", "x.*")
    texts = one.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    rows = paths(one, branches).join(texts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    head = F.concat(F.lit(START), escape(F.col("role"), True), F.lit("\n"))
    rows = rows.select("tree", "leaf", "branch", "pos", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    rows = rows.withColumn("turn", F.concat("head", "body", F.lit(END)))
    along = Window.partitionBy("tree", "leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.sum(F.length("turn").cast("long")).over(along) - F.length("turn") + F.length("head"))
    span = F.when(F.col("role") == "assistant", F.struct("start", (F.col("start") + F.length("body")).alias("stop")))
    turns = rows.groupBy("tree", "leaf").agg(F.first("branch").alias("branch"), F.array_sort(F.collect_list(F.struct("pos", "turn", span.alias("span")))).alias("turns"))
    spans = F.filter(F.transform("turns", lambda x: x["span"]), lambda s: s.isNotNull())
    return turns.select("tree", "leaf", "branch", F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("formatted"), spans.alias("loss_mask"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text), unescaped."""

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(START) + 1), F.length(piece))
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescape(role, True).alias("role"), unescape(F.substring(body, F.length(role) + 2, F.length(body))).alias("text"))

    return F.transform(F.filter(F.split(formatted, END_PATTERN, -1), lambda p: p != ""), turn)


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, in order."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")


def digests(conversations: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its formatted form."""
    done = format_trees(as_trees(conversations)).select("tree", "formatted", parse(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
