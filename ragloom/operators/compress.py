"""Prompt-compression operators on token tables: key, i, and a probability or an information value for each token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def information_mask(units: DataFrame, share: float, key: str = "key", value: str = "value") -> DataFrame:
    """Units with whether their self-information reaches the ``share`` quantile of their text."""
    cut = units.groupBy(key).agg(F.percentile(value, F.lit(share)).alias("cutoff"))
    return units.join(cut, key).withColumn("kept", F.col(value) >= F.col("cutoff")).drop("cutoff")


def word_probabilities(tokens: DataFrame, starts: Column, forced: Column, key: str = "key", order: str = "i", prob: str = "p") -> DataFrame:
    """Tokens merged to words: a word runs from a token that starts one to the next; forced words get 1, others the mean of their tokens."""
    along = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = tokens.withColumn("word", F.sum(starts.cast("long")).over(along)).withColumn("forced", forced)
    out = rows.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n_tokens"), F.when(F.max(F.col("forced").cast("int")) == 1, 1.0).otherwise(F.avg(prob)).alias("p"))
    return out.select(key, "word", "n_tokens", "p")


def fitting_prefix(passages: DataFrame, budget: int, key: str = "key", order: str = "i", tokens: str = "tokens") -> DataFrame:
    """How many passages, from the first on, fit into ``budget`` tokens, and their tokens; token counts are not negative, so the running sum tells."""
    along = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = passages.withColumn("sum", F.sum(tokens).over(along))
    return rows.groupBy(key).agg(F.count_if(F.col("sum") <= budget).alias("n_fit"), F.coalesce(F.max(F.when(F.col("sum") <= budget, F.col("sum"))), F.lit(0)).alias("tokens"))


def scaled(rows: DataFrame, key: str, value: str, levels: int = 8) -> DataFrame:
    """``level``: the value's place between its group's least and largest, from 0 to ``levels`` - 1."""
    ends = rows.groupBy(key).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    share = (F.col(value) - F.col("low")) / (F.col("high") - F.col("low"))
    return rows.join(ends, key).withColumn("level", F.when(F.col("high") > F.col("low"), F.floor(share * (levels - 1) + 0.5)).otherwise(F.lit(0)).cast("long")).drop("low", "high")


# The weights of BM25 over a question's own contexts, and the share of the mean idf that stands in for a negative one.
K1, B, FLOOR_SHARE = 1.5, 0.75, 0.25


def bm25_order(contexts: DataFrame, questions: DataFrame, key: str = "key", place: str = "i") -> DataFrame:
    """``key``, ``place``, ``score``, ``rank``: each question's contexts by BM25 among themselves, best first, ties by place.

    Words are what single spaces part, as they are; a word that more than half of the contexts have gets a quarter of the mean idf of all the contexts' words. ``contexts``: key, place, text; ``questions``: key, text.
    """
    words = contexts.select(key, place, F.split(F.coalesce("text", F.lit("")), " ").alias("words"))
    each = words.select(key, place, F.size("words").alias("dl"), F.explode("words").alias("word")).groupBy(key, place, "dl", "word").agg(F.count(F.lit(1)).alias("tf"))
    sizes = words.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("avgdl"))
    df = each.groupBy(key, "word").agg(F.count(F.lit(1)).alias("df")).join(sizes, key)
    idf = df.select(key, "word", "avgdl", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = F.avg("idf").over(Window.partitionBy(key))
    idf = idf.withColumn("idf", F.when(F.col("idf") < 0, F.lit(FLOOR_SHARE) * mean).otherwise(F.col("idf")))
    asked = questions.select(key, F.explode(F.split("text", " ")).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("q"))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.col("avgdl")))
    scored = each.join(asked, [key, "word"]).join(idf, [key, "word"]).groupBy(key, place).agg(F.sum(F.col("q") * F.col("idf") * weight).alias("score"))
    rows = words.select(key, place).join(scored, [key, place], "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 9))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), place)))


def token_rates(tokens: DataFrame, segments: DataFrame, window: int, key: str = "key") -> DataFrame:
    """Compression rates of a text's tokens, from the rates of its segments, in windows of ``window`` tokens: key, window, run, n (tokens), rate.

    ``tokens``: key, i (from 0), n_chars; ``segments``: key, s, n_chars, rate, compress; both in order make up the text. A token in one segment has its rate; one that reaches into others has the least of
    theirs, or 1 if one of them isn't to be compressed. A token without characters, and one beyond the last segment, goes with the segment that follows the text so far, or else the last one. Neighbours with one rate in a
    window are a run.
    """
    along = lambda order: Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    t = tokens.select(key, "i", "n_chars", (F.sum("n_chars").over(along("i")) - F.col("n_chars")).alias("start"))
    s = segments.where("n_chars > 0").select(key, "s", "rate", "compress", F.sum("n_chars").over(along("s")).alias("stop"), F.col("n_chars").alias("size"))
    parts = s.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("s", (F.col("stop") - F.col("size")).alias("start"), "stop", "rate", "compress"))).alias("parts"))
    rows = t.join(parts, key)
    met = F.filter("parts", lambda p: (p["start"] < F.greatest(F.col("start") + F.col("n_chars"), F.col("start") + 1)) & (p["stop"] > F.col("start")))
    rows = rows.withColumn("met", met).withColumn("met", F.when(F.size("met") > 0, F.col("met")).otherwise(F.slice("parts", -1, 1)))
    least = F.array_min(F.transform("met", lambda p: p["rate"]))
    rate = F.when((F.size("met") > 1) & F.exists("met", lambda p: ~p["compress"]), 1.0).otherwise(least)
    rows = rows.select(key, "i", F.floor(F.col("i") / window).alias("window"), rate.alias("rate"))
    own = Window.partitionBy(key, "window").orderBy("i")
    rows = rows.withColumn("new", F.coalesce((F.col("rate") != F.lag("rate").over(own)).cast("int"), F.lit(0)))
    rows = rows.withColumn("run", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "window", "run").agg(F.count(F.lit(1)).alias("n"), F.first("rate").alias("rate"))
