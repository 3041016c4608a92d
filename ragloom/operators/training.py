"""Training tables: hard examples, labels of steps, values written back to traces, exemplars, severed graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragloom.functions import metrics as M
from ragloom.functions.fuzzy import token_sort
from ragloom.operators import kg_tables as T
from ragloom.operators.curate import severed
from ragloom.operators.retrieval import dense


def accepted(traces: DataFrame) -> DataFrame:
    """Traces that the quota accepted; a null decision is none."""
    return traces.where(F.coalesce("accepted", F.lit(False)))


def with_gold(rows: DataFrame, golds: str = "golden_answers") -> DataFrame:
    """Rows with at least one golden answer that isn't blank."""
    return rows.where(F.coalesce(F.exists(golds, lambda g: F.trim(g) != ""), F.lit(False)))


def hard_examples(rows: DataFrame, pred: str = "pred", golds: str = "golden_answers") -> DataFrame:
    """Rows with golden answers of which the prediction equals none; no prediction is a wrong one."""
    return with_gold(rows, golds).where(F.col(pred).isNull() | (M.em(F.coalesce(pred, F.lit("")), F.col(golds)) == 0))


def binary_steps(steps: DataFrame, label: str = "label") -> DataFrame:
    """Steps that are labelled good or bad; neutral ones go."""
    return steps.where(F.col(label) != 0)


def strict_label(label: Column) -> Column:
    """A neutral step counts as a bad one."""
    return F.when(label == 0, -1).otherwise(label)


def written_back(traces: DataFrame, values: DataFrame, key: str, steps: str, name: str) -> DataFrame:
    """``traces`` with an array ``name`` beside ``steps``: the ``value`` of each step by its place from 0 (``values``: key, step, value), null where there is none."""
    found = values.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("step", "value"))).alias("by_step"))
    places = F.when(F.size(steps) > 0, F.sequence(F.lit(0), F.size(steps) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    rows = traces.join(found, key, "left")
    return rows.select(*traces.columns, F.transform(places, lambda i: F.try_element_at("by_step", i)).alias(name))


def alpha_of_answers(rows: DataFrame, key: str, alpha: str) -> DataFrame:
    """Mean gate of each answer and its population deviation (0 for a single step)."""
    return rows.groupBy(key).agg(F.count(alpha).alias("n"), F.avg(alpha).alias("alpha_mean"), F.coalesce(F.stddev_pop(alpha), F.lit(0.0)).alias("alpha_std"))


def update_summary(rows: DataFrame, name: str, value: str) -> DataFrame:
    """Mean, sample deviation (0 for a single update), least, largest and number of a log's values."""
    v = F.col(value)
    return rows.groupBy(name).agg(F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n_updates"))


def label_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """How often each label became which, over all steps, those of right answers and those without a citation: ``old`` has keys, label, right,
    n_cited; ``new`` keys, label. The keys name a step once in each.
    """
    both = old.withColumnRenamed("label", "old_label").join(new.select(*keys, F.col("label").alias("new_label")), keys)
    return both.groupBy("old_label", "new_label").agg(F.count(F.lit(1)).alias("n"), F.count_if("right").alias("n_right"), F.count_if(F.col("n_cited") == 0).alias("n_uncited"))


def exemplars(items: DataFrame, examples: DataFrame, n: int) -> DataFrame:
    """``qid`` and the texts of its ``n`` nearest examples by inner product, nearest first: ``items`` has qid, v; ``examples`` doc_id, v, text."""
    hits = dense(examples.select("doc_id", "v"), items.select("qid", "v"), n).join(examples.select("doc_id", "text"), "doc_id")
    return hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("exemplars"))


def severed_answers(graph: DataFrame, answers: DataFrame, cutoff: float = 70.0) -> DataFrame:
    """``graph`` (qid, h, r, t) with the triples whose head or tail resembles its question's answer replaced by noise; ``severed`` marks them."""
    near = lambda c: token_sort(F.lower(c), F.col("sought")) >= cutoff
    rows = graph.join(answers.select("qid", F.lower(F.trim("answer")).alias("sought")), "qid", "left").withColumn("key", F.concat_ws("|", "qid", "h", "r", "t"))
    rows = rows.withColumn("near", F.col("sought").isNotNull() & (near("h") | near("t")))
    return severed(rows, F.col("near"), "key", T.NOISE_ENTITIES, T.NOISE_RELATIONS).select("qid", "h", "r", "t", "severed")


def severed_items(items: DataFrame, graph: DataFrame, most: int) -> DataFrame:
    """A row for each item (qid): ``n_original``, ``n_severed`` triples of its graph (qid, severed), ``n_kept`` (what of it fits ``most``), and whether it has none; 0 for an item without a graph."""
    counts = graph.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.count_if("severed").alias("gone"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = items.select("qid").distinct().join(counts, "qid", "left")
    return rows.select("qid", zero("n").alias("n_original"), zero("gone").alias("n_severed"), F.least(zero("n"), F.lit(most)).alias("n_kept"), F.col("n").isNull().alias("no_graph"))


def route_of(scores: DataFrame, key: str, route: str = "route", logit: str = "logit") -> DataFrame:
    """The route with the greatest share of a classifier's exponentiated logits, and that share; ties to the first by name."""
    whole = Window.partitionBy(key)
    power = F.exp(F.col(logit) - F.max(logit).over(whole))
    rows = scores.withColumn("share", power).withColumn("share", F.col("share") / F.sum("share").over(whole))
    order = whole.orderBy(F.col(logit).desc(), route)
    return rows.withColumn("nth", F.row_number().over(order)).where("nth = 1").select(key, route, "share")


def unit_information(tokens: DataFrame, units: DataFrame) -> DataFrame:
    """Mean information of each unit of a text from that of its tokens: key, u, value (null for a unit that gets nothing).

    ``tokens``: key, i, token, value; ``units``: key, u, unit. Both spell the same text in order. A token that completes units shares its value among these; one that completes
    none gives it to the unit it stands in, unless it is a space. Positions meet in one sort for each text, so nothing is compared in pairs.
    """
    along = lambda order: Window.partitionBy("key").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = units.select("key", "u", F.sum(F.length("unit")).over(along("u")).alias("at"), F.row_number().over(Window.partitionBy("key").orderBy("u")).alias("place"))
    spans = tokens.select("key", "i", "value", "token", F.sum(F.length("token")).over(along("i")).alias("stop"))
    points = F.explode(F.array(F.struct((F.col("stop") - F.length("token")).alias("at"), F.lit(False).alias("last")), F.struct(F.col("stop").alias("at"), F.lit(True).alias("last"))))
    marks = spans.select("key", "i", "value", "token", points.alias("x")).select("key", "i", "value", "token", "x.at", "x.last", F.lit(0).alias("ended"))
    both = marks.unionByName(ends.select("key", "at", F.lit(1).alias("ended")), allowMissingColumns=True)
    passed = F.sum("ended").over(Window.partitionBy("key").orderBy("at", F.col("ended").desc()).rowsBetween(Window.unboundedPreceding, 0))
    counted = both.withColumn("passed", passed).where("ended = 0").groupBy("key", "i").agg(
        F.first("value").alias("value"), F.first("token").alias("token"), F.max(F.when(~F.col("last"), F.col("passed"))).alias("before"), F.max(F.when(F.col("last"), F.col("passed"))).alias("after")
    )
    done = F.col("after") - F.col("before")
    given = counted.where((done > 0) | (F.col("token") != " ")).select(
        "key", (F.col("value") / F.greatest(F.lit(1), done)).alias("part"), F.explode(F.sequence(F.col("before") + 1, F.greatest("after", F.col("before") + 1))).alias("place")
    )
    means = given.groupBy("key", "place").agg(F.avg("part").alias("value"))
    return ends.join(means, ["key", "place"], "left").select("key", "u", "value")
