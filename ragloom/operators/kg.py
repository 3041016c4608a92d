"""Knowledge-graph operators on edge tables (h, r, t).

Long tables throughout: a row for each triple of a question, with an explicit position, so every ordered operator has a total order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragloom.operators import kg_tables as T
from ragloom.session import fresh

# What a known link scores.
OVERRIDE_SCORE, OVERRIDE_MARGIN = 0.95, 0.50
#: Known links up to which they are broadcast.
OVERRIDE_ROWS = 100_000


def one_hop(seeds: DataFrame, edges: DataFrame, limit: int = 30, relations: list[str] | None = None) -> DataFrame:
    """``qid``, ``hop``, ``pos``, ``h``, ``r``, ``t``: the first ``limit`` edges of each seed by relation and tail.

    ``seeds`` has ``qid`` and ``seed``, and may have ``place``, the seed's place in its question; otherwise seeds go by name.
    ``pos`` counts on over the seeds of a question. A relation whitelist is pushed to the scan of the edges.
    """
    if relations is not None:
        edges = edges.where(F.col("r").isin(relations))
    found = _placed(seeds).join(edges, F.col("seed") == F.col("h")).select("qid", "place", "seed", "h", "r", "t")
    first = Window.partitionBy("qid", "seed").orderBy("r", "t", "h")
    found = found.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= limit)
    return found.withColumn("pos", _counted_on()).select("qid", F.lit(1).alias("hop"), "pos", "h", "r", "t")


def _placed(seeds: DataFrame) -> DataFrame:
    """``qid``, ``seed``, ``place``, each seed of a question once."""
    place = F.min("place") if "place" in seeds.columns else F.lit(0)
    return seeds.groupBy("qid", "seed").agg(place.alias("place"))


def _counted_on() -> Column:
    return F.row_number().over(Window.partitionBy("qid").orderBy("place", "seed", "nth")).cast("long")


def two_hop(seeds: DataFrame, edges: DataFrame, limit: int = 30) -> DataFrame:
    """As ``one_hop`` over paths of two edges; both edges of a path are given, one after the other.

    The first ``limit`` paths of a seed go over its first ``limit`` edges that lead on, and over the first ``limit`` edges of each node there, so a hub adds no more than these.
    """
    near = _placed(seeds).join(edges, F.col("seed") == F.col("h")).join(edges.select(F.col("h").alias("t")), "t", "left_semi")
    near = near.withColumn("nth", F.row_number().over(Window.partitionBy("qid", "seed").orderBy("r", "t", "h"))).where(F.col("nth") <= limit).drop("nth")
    far = edges.select(F.col("h").alias("h2"), F.col("r").alias("r2"), F.col("t").alias("t2")).join(near.select(F.col("t").alias("h2")), "h2", "left_semi")
    far = far.withColumn("nth", F.row_number().over(Window.partitionBy("h2").orderBy("r2", "t2"))).where(F.col("nth") <= limit).drop("nth")
    paths = near.join(far, F.col("t") == F.col("h2"))
    first = Window.partitionBy("qid", "seed").orderBy("r", "t", "r2", "t2", "h")
    paths = paths.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= limit).withColumn("n", _counted_on())
    both = F.array(
        F.struct((2 * F.col("n") - 1).alias("pos"), F.col("h").alias("h"), F.col("r").alias("r"), F.col("t").alias("t")),
        F.struct((2 * F.col("n")).alias("pos"), F.col("h2").alias("h"), F.col("r2").alias("r"), F.col("t2").alias("t")),
    )
    return paths.select("qid", F.explode(both).alias("e")).select("qid", F.lit(2).alias("hop"), "e.pos", "e.h", "e.r", "e.t")


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """DISTINCT on ``keys`` that keeps the first row in ``order``."""
    first, nth = Window.partitionBy(*keys).orderBy(*order), fresh("nth", rows)
    return rows.withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).drop(nth)


def merged_hops(seeds: DataFrame, edges: DataFrame, limit: int = 30) -> DataFrame:
    """One- and two-hop triples of each question without repeats, with ``pos`` in order of hop and position."""
    rows = keep_first(one_hop(seeds, edges, limit).unionByName(two_hop(seeds, edges, limit)), ["qid", "h", "r", "t"], ["hop", "pos"])
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("hop", "pos")).cast("long"))


def is_hard_deleted(h: Column, r: Column, t: Column) -> Column:
    blank = [F.trim(c) == "" for c in (h, r, t)]
    return h.isin(*T.META_LABELS) | t.isin(*T.META_LABELS) | r.isin(*T.STOP_RELATIONS) | (F.lower(h) == F.lower(t)) | blank[0] | blank[1] | blank[2]


def pid_of(r: Column) -> Column:
    """The property id of a relation: its own prefix, else that of its label, else empty."""
    labels = F.create_map(*[F.lit(x) for pair in T.RELATION_PIDS.items() for x in pair])
    own = F.regexp_extract(r, r"^(P[0-9]+)", 1)
    return F.when(own != "", own).otherwise(F.coalesce(F.element_at(labels, F.lower(r)), F.lit("")))


def quotas(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One taxonomic triple for each head and relation, then at most 15 % of the rest (one at least) for each relation.

    Relations without a property id share one bucket.
    """
    keys = keys or ["qid"]
    nth, most = fresh("nth", rows), fresh("most", rows)
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(*keys, "pid", "h").orderBy("pos"))).where(~F.col("pid").isin(*T.TAXONOMIC) | (F.col(nth) <= 1))
    total = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rows = rows.withColumn(most, F.greatest(F.floor(total * F.lit(T.RELATION_SHARE)), F.lit(1)))
    return rows.withColumn(nth, F.row_number().over(Window.partitionBy(*keys, "pid").orderBy("pos"))).where(F.col(nth) <= F.col(most)).drop(nth, most)


def entity_score(entity: Column, question: Column) -> Column:
    """1 if the question holds the entity, 0.5 if it holds its last word, of two or more."""
    name = F.lower(F.regexp_replace(entity, r"^\s+|\s+$", ""))
    words = F.split(name, r"\s+")
    last = F.element_at(words, -1)
    return F.when(name == "", 0.0).when(F.contains(question, name), 1.0).when((F.size(words) >= 2) & F.contains(question, last), 0.5).otherwise(0.0)


def relation_score(pid: Column, question: Column) -> Column:
    by_pid: dict[str, list[str]] = {}
    for keyword, pids in T.KEYWORD_PIDS.items():
        for p in pids:
            by_pid.setdefault(p, []).append(keyword)
    table = F.create_map(*[x for p, words in by_pid.items() for x in (F.lit(p), F.array(*[F.lit(w) for w in words]))])
    return F.when(F.coalesce(F.exists(F.element_at(table, pid), lambda w: F.contains(question, w)), F.lit(False)), 1.0).otherwise(0.0)


def triple_score(h: Column, r: Column, t: Column, pid: Column, question: Column) -> Column:
    q = F.lower(question)
    entity = F.greatest(entity_score(h, q), entity_score(t, q))
    overlap = F.when(F.exists(F.split(F.lower(r), r"\s+"), lambda w: (F.length(w) > 2) & F.contains(q, w)), 0.25).otherwise(0.0)
    penalty = reduce(lambda c, x: c.when(pid == x[0], x[1]), T.PENALTIES.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    return F.lit(0.30) * entity + F.lit(0.25) * relation_score(pid, q) + F.lit(0.25) * overlap - penalty


def taxonomic_cap(rows: DataFrame, keep: int = 30) -> DataFrame:
    """Of the best ``2 * keep`` rows of a question, at most a fifth taxonomic; then the best ``keep``, with ``rank``."""
    place, taxonomic, most, nth = (fresh(x, rows) for x in ("place", "taxonomic", "most", "nth"))
    by_score = Window.partitionBy("qid").orderBy(F.col("score").desc(), "pos")
    best = rows.withColumn(place, F.row_number().over(by_score)).where(F.col(place) <= 2 * keep)
    best = best.withColumn(taxonomic, F.col("pid").isin(*T.TAXONOMIC))
    total = F.least(F.lit(keep), F.count(F.lit(1)).over(Window.partitionBy("qid")))
    best = best.withColumn(most, F.floor(total * F.lit(T.TAXONOMIC_SHARE)))
    best = best.withColumn(nth, F.row_number().over(Window.partitionBy("qid", taxonomic).orderBy(place))).where(~F.col(taxonomic) | (F.col(nth) <= F.col(most)))
    last = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col(taxonomic).desc(), place)
    return best.withColumn("rank", F.row_number().over(last).cast("long")).where(F.col("rank") <= keep).drop(place, taxonomic, most, nth)


def filter_and_rank(candidates: DataFrame, questions: DataFrame, keep: int = 30) -> DataFrame:
    """Hard deletion, quotas, scores, ranks: the best ``keep`` triples of each question.

    ``candidates`` has ``qid``, ``hop``, ``pos``, ``h``, ``r``, ``t``; ``questions`` has ``qid`` and ``question``.
    """
    rows = candidates.where(~is_hard_deleted(F.col("h"), F.col("r"), F.col("t"))).withColumn("pid", pid_of(F.col("r")))
    rows = quotas(rows).join(questions.select("qid", "question"), "qid")
    rows = rows.withColumn("score", triple_score(F.col("h"), F.col("r"), F.col("t"), F.col("pid"), F.col("question"))).drop("question")
    return taxonomic_cap(rows, keep).select("qid", "rank", "h", "pid", "r", "t", F.bround("score", 4).alias("score"), "hop")


def relation_frequency(edges: DataFrame, top: int = 20) -> DataFrame:
    return edges.groupBy("r").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "r").limit(top)


def density(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (repeats count) over distinct nodes, for each group."""
    edges = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_edges"))
    nodes = rows.select(*keys, F.explode(F.array("h", "t")).alias("node")).groupBy(*keys).agg(F.count_distinct("node").alias("n_nodes"))
    return edges.join(nodes, keys).withColumn("density", F.col("n_edges") / (F.col("n_nodes") + F.lit(1e-6)))


def last_wins(log: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """An append-only log folded to its last value for each key."""
    return log.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def link(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """``mentions`` with the ``qid_linked`` of the entity whose cleaned label equals the cleaned mention, or null."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"^\s+|\s+$", ""), r"\s+", " ")
    known = entities.select(clean(F.col("label")).alias("label_key"), F.col("entity_id").alias("qid_linked"))
    known = known.groupBy("label_key").agg(F.max("qid_linked").alias("qid_linked"))
    return mentions.withColumn("label_key", clean(F.col("mention"))).join(known, "label_key", "left").drop("label_key")


def effective_graph(items: DataFrame) -> DataFrame:
    """Items with ``effective_kg``: the severed graph where there is one, else the original."""
    return items.withColumn("effective_kg", F.coalesce("modified_kg", "original_kg"))


def link_scores(candidates: DataFrame) -> DataFrame:
    """``score`` of each link candidate in [0, 1]: label match, words shared with the question, expected type, less for pages that are no entity.

    Columns: mention, question, entity_id, label, description, expected_types.
    """
    label, mention, description = F.lower("label"), F.lower("mention"), F.lower("description")
    match = F.when(label == mention, 0.30).when(F.contains(label, mention) | F.contains(mention, label), 0.20).otherwise(0.10)
    split = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    words = split(description)
    shared = F.size(F.array_intersect(words, split(F.lower("question"))))
    context = F.lit(0.30) * F.least(F.lit(1.0), shared / F.greatest(F.lit(1), F.size(words)))
    typed = F.when(F.coalesce(F.exists("expected_types", lambda t: F.contains(description, t)), F.lit(False)), 0.20).otherwise(0.0)
    barred = F.when(F.col("entity_id").isin(*T.PAGE_ENTITIES) | description.isin(*T.PAGE_DESCRIPTIONS), 0.50).otherwise(0.0)
    return candidates.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), match + context + typed - barred)))


def link_decisions(scored: DataFrame, least_score: float = 0.15, least_margin: float = 0.05) -> DataFrame:
    """The best candidate of each mention, with its margin over the second; too low a score or, of several candidates, margin abstains."""
    order = Window.partitionBy("mention").orderBy(F.col("score").desc(), "entity_id")
    rows = scored.withColumn("second", F.lead("score").over(order)).withColumn("nth", F.row_number().over(order)).where("nth = 1")
    margin = F.col("score") - F.coalesce("second", F.lit(0.0))
    reason = F.when(F.col("score") < least_score, "low score").when(F.col("second").isNotNull() & (margin < least_margin), "low margin")
    return rows.select("mention", F.when(reason.isNull(), F.col("entity_id")).alias("entity_id"), "score", margin.alias("margin"), reason.alias("abstained"))


def overridden(decisions: DataFrame, mentions: DataFrame, overrides: DataFrame) -> DataFrame:
    """``link_decisions`` with a table of known links before them: mention, entity_id, score, margin, abstained.

    ``mentions``: mention, expected_types (array or null); ``overrides``: mention (cleaned), kind, entity_id. Of a mention's overrides the one of its first expected type that has one counts, else the
    kind ``default``; a mention with neither is left to its decision, and one without a decision has no candidates.
    """
    clean = F.lower(F.trim(F.regexp_replace("mention", r"\s+", " ")))
    table = overrides.groupBy(F.col("mention").alias("known")).agg(F.map_from_entries(F.collect_list(F.struct("kind", "entity_id"))).alias("fixes"))
    rows = mentions.join(F.broadcast(table) if overrides.count() <= OVERRIDE_ROWS else table, clean == F.col("known"), "left").join(decisions, "mention", "left")
    kinds = F.concat(F.coalesce("expected_types", F.array().cast("array<string>")), F.array(F.lit("default")))
    fix = F.get(F.filter(F.transform(kinds, lambda k: F.try_element_at("fixes", k)), lambda x: x.isNotNull()), F.lit(0))
    rows = rows.withColumn("fix", fix)
    pick = lambda known, found: F.when(F.col("fix").isNotNull(), known).otherwise(found)
    reason = F.coalesce("abstained", F.when(F.col("score").isNull(), "no candidates"))
    return rows.select("mention", pick(F.col("fix"), F.col("entity_id")).alias("entity_id"), pick(F.lit(OVERRIDE_SCORE), F.col("score")).alias("score"), pick(F.lit(OVERRIDE_MARGIN), F.col("margin")).alias("margin"), pick(F.lit(None), reason).alias("abstained"))


def relevant_triples(triples: DataFrame, contexts: DataFrame, top: int) -> DataFrame:
    """The ``top`` triples of each question by words shared with its context, ties by position; in their own order if none shares any.

    ``triples``: qid, pos, h, r, t; ``contexts``: qid, context.
    """
    terms = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    rows = triples.join(contexts.select("qid", terms(F.col("context")).alias("known")), "qid")
    rows = rows.withColumn("overlap", F.size(F.array_intersect("known", terms(F.concat_ws(" ", "h", "r", "t"))))).drop("known")
    best = Window.partitionBy("qid").orderBy(F.col("overlap").desc(), "pos")
    return rows.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)


def triples_in_graph(cited: DataFrame, graph: DataFrame) -> DataFrame:
    """``cited`` with whether the triple is in its question's graph, case aside (qid, h, r, t)."""
    keys = [F.lower(c).alias(f"k_{c}") for c in ("h", "r", "t")]
    known = graph.select(F.col("qid").alias("k_q"), *keys).distinct().withColumn("found", F.lit(True))
    on = (F.col("qid") == F.col("k_q")) & (F.lower("h") == F.col("k_h")) & (F.lower("r") == F.col("k_r")) & (F.lower("t") == F.col("k_t"))
    return cited.join(known, on, "left").select(*cited.columns, F.coalesce("found", F.lit(False)).alias("verified"))
