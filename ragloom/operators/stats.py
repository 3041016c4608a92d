"""Statistics: summaries, t tests, agreement, bootstrap."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragloom.session import fresh


def summary(rows: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """n, mean, sample deviation (0 for one value), median, 10 % and 90 % points by linear interpolation."""
    q = F.percentile(column, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q")
    out = rows.groupBy(*(keys or [])).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.coalesce(F.stddev_samp(column), F.lit(0.0)).alias("std"), q)
    return out.select(*(keys or []), "n", "mean", "std", *[F.col("q")[i].alias(n) for i, n in enumerate(("p10", "median", "p90"))])


def kappa(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """Cohen's kappa of two 0/1 labels; 1 where chance agreement is complete."""
    x, y = a.cast("double"), b.cast("double")
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.avg((x == y).cast("double")).alias("po"), F.avg(x).alias("pa"), F.avg(y).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return s.select("n", "po", F.when(F.abs(1 - pe) < 1e-12, 1.0).otherwise((F.col("po") - pe) / (1 - pe)).alias("kappa"))


def paired_t(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    d = a.cast("double") - b.cast("double")
    s = rows.agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("std_diff"))
    out = s.withColumn("t", F.col("mean_diff") / (F.col("std_diff") / F.sqrt("n")))
    return out.withColumn("p", t_two_sided(F.col("t"), (F.col("n") - 1).cast("double")))


def welch_t(rows: DataFrame, group: Column, value: Column) -> DataFrame:
    """Welch's t of the values where ``group`` is true against the rest."""
    v = value.cast("double")
    one, two = F.when(group, v), F.when(~group, v)
    s = rows.agg(*[f(c).alias(f"{n}{i}") for i, c in ((1, one), (2, two)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    df = (a + b) ** 2 / (a**2 / (F.col("n1") - 1) + b**2 / (F.col("n2") - 1))
    out = s.select("n1", "n2", F.col("m1").alias("mean1"), F.col("m2").alias("mean2"), ((F.col("m1") - F.col("m2")) / F.sqrt(a + b)).alias("t"), df.alias("df"))
    return out.withColumn("p", t_two_sided(F.col("t"), F.col("df")))


def _beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * math.copysign(1, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def t_tail(t: float, df: float) -> float:
    """Two-sided probability of Student's t."""
    if not (math.isfinite(t) and df > 0):
        return 0.0 if math.isinf(t) and df > 0 else math.nan
    x, a, b = df / (df + t * t), df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    return front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - x) / b


def t_quantile(p: float, df: float) -> float:
    """The t with probability ``p`` (over 0.5) below it, by bisection."""
    low, high = 0.0, 1.0
    while t_tail(high, df) / 2 > 1 - p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_tail(mid, df) / 2 > 1 - p else (low, mid)
    return (low + high) / 2


def t_two_sided(t: Column, df: Column) -> Column:
    @F.arrow_udf("double")
    def tail(ts: pa.Array, dfs: pa.Array) -> pa.Array:
        return pa.array([None if x is None or d is None else t_tail(x, d) for x, d in zip(ts.to_pylist(), dfs.to_pylist())], pa.float64())

    return tail(t, df)


def mean_ci(rows: DataFrame, keys: list[str], column: str, level: float = 0.95) -> DataFrame:
    """Mean, deviation and the half-width of the t interval by group; 0 for one value."""

    @F.arrow_udf("double")
    def quantile(dfs: pa.Array) -> pa.Array:
        known = {d: t_quantile(0.5 + level / 2, d) if d and d > 0 else 0.0 for d in set(dfs.to_pylist())}
        return pa.array([known[d] for d in dfs.to_pylist()], pa.float64())

    out = rows.groupBy(*keys).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.coalesce(F.stddev_samp(column), F.lit(0.0)).alias("std"))
    return out.withColumn("ci", quantile((F.col("n") - 1).cast("double")) * F.col("std") / F.sqrt("n"))


def _uniform(keys: np.ndarray, draw: int, seed: int) -> np.ndarray:
    """Uniform numbers in (0, 1) that depend on the key, the draw and the seed alone."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(draw) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53) + 2.0**-54


def paired_bootstrap(rows: DataFrame, key: str, a: str, b: str, resamples: int = 10_000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Mean difference, its bootstrap interval and a two-sided p, by Poisson resampling: ``paired_bootstrap_by`` of one group."""
    return paired_bootstrap_by(rows, [], key, a, b, resamples, seed, level).select("low", "high", "p", "mean_diff")


def paired_bootstrap_by(rows: DataFrame, groups: list[str], key: str, a: str, b: str, resamples: int = 10_000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """``paired_bootstrap`` of every group (a data set, a metric) in one pass: the groups, n, mean_diff, low, high, p.

    Each task draws a Poisson(1) weight for each item and resample, from the item's key alone, so all groups share the weights of an item, and adds up ``resamples`` sums for each of its groups;
    tasks' sums are added up. No task sees all rows, and the result doesn't depend on the partitions. A pair of which one value is missing is left out. Groups are few: a task holds their sums.
    """
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    one, name, code_of = fresh("one", rows), fresh("group", rows), fresh("code", rows)
    d = rows.select(F.xxhash64(key).alias("k"), (F.col(a).cast("double") - F.col(b).cast("double")).alias("d"), F.to_json(F.struct(*groups, F.lit(1).alias(one))).alias(name), *groups).where("d is not null")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight: dict[str, np.ndarray] = {}
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            keys, d = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            coded = batch.column(2).dictionary_encode()
            names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            w_of, s_of = np.empty((len(names), resamples)), np.empty((len(names), resamples))
            for i in range(resamples):
                w = np.searchsorted(steps, _uniform(keys, i, seed)).astype(np.float64)
                w_of[:, i], s_of[:, i] = np.bincount(code, w, len(names)), np.bincount(code, w * d, len(names))
            for g, w_row, s_row in zip(names, w_of, s_of):
                weight[g] = weight.get(g, 0.0) + w_row
                total[g] = total.get(g, 0.0) + s_row
        for g in weight:
            yield pa.RecordBatch.from_arrays([pa.array([g] * resamples, pa.string()), pa.array(np.arange(resamples)), pa.array(weight[g]), pa.array(total[g])], names=["g", "i", "w", "s"])

    sums = d.select("k", "d", name).mapInArrow(draw, "g string, i long, w double, s double").groupBy(F.col("g").alias(code_of), "i").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("mean"))
    low, high = (1 - level) / 2, (1 + level) / 2
    tails = F.least(F.avg((F.col("mean") <= 0).cast("double")), F.avg((F.col("mean") >= 0).cast("double")))
    ends = sums.groupBy(code_of).agg(F.percentile("mean", F.lit(low)).alias("low"), F.percentile("mean", F.lit(high)).alias("high"), F.least(F.lit(1.0), 2 * tails).alias("p"))
    means = d.groupBy(name, *groups).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_diff"))
    return means.join(F.broadcast(ends), F.col(name) == F.col(code_of)).select(*groups, "n", "mean_diff", "low", "high", "p")


def adjusted(tests: DataFrame, p: str = "p", families: list[str] | None = None) -> DataFrame:
    """``tests``, a row for each, with ``p_holm`` (the family's error rate) and ``p_bh`` (the rate of false discoveries) for all tests of a family."""
    n, place = fresh("n", tests), fresh("place", tests)
    family = Window.partitionBy(*(families or [F.lit(0)]))  # tests are few
    rows = tests.withColumn(n, F.count(p).over(family)).withColumn(place, F.row_number().over(family.orderBy(F.col(p).asc_nulls_last())))
    holm = F.max(F.col(p) * (F.col(n) - F.col(place) + 1)).over(family.orderBy(place).rowsBetween(Window.unboundedPreceding, 0))
    bh = F.min(F.col(p) * F.col(n) / F.col(place)).over(family.orderBy(F.col(place).desc()).rowsBetween(Window.unboundedPreceding, 0))
    known = lambda x: F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), x))
    return rows.withColumn("p_holm", known(holm)).withColumn("p_bh", known(bh)).drop(n, place)


# The bands of the divergence from the first policy, and when a reward counts as gone: so many last rows at most this, after one over that.
KL_BANDS = ((0.0, 50.0), (1.0, 12.0))
LAST_ROWS, GONE, WAS, LEAST_ROWS = 4, 1e-6, 0.05, 8


def kl_verdict(kl: Column) -> Column:
    """nan, diverging, healthy, very low or high; null without a value."""
    (low, most), (least, good) = KL_BANDS
    return F.when(F.isnan(kl), "nan").when((kl < low) | (kl > most), "diverging").when((kl >= least) & (kl <= good), "healthy").when(kl < least, "very low").when(kl.isNotNull(), "high")


def reward_collapse(rows: DataFrame, key: str, order: str, reward: str) -> DataFrame:
    """``key``, ``n``, ``collapsed``: whether a run of eight rows or more has had a reward and has none in its last four."""
    back = fresh("back", rows)
    placed = rows.withColumn(back, F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc())))
    was = F.max(F.when(F.col(back) > LAST_ROWS, F.col(reward)))
    now = F.max(F.when(F.col(back) <= LAST_ROWS, F.col(reward)))
    out = placed.groupBy(key).agg(F.count(F.lit(1)).alias("n"), was.alias("was"), now.alias("now"))
    return out.select(key, "n", F.coalesce((F.col("n") >= LEAST_ROWS) & (F.col("was") > WAS) & (F.col("now") <= GONE), F.lit(False)).alias("collapsed"))


def calibration_loss(rows: DataFrame, label: Column, chance: Column, weight: float = 0.1) -> DataFrame:
    """Weighted mean binary cross entropy; logarithms are at least -100."""
    ln = lambda c: F.greatest(F.coalesce(F.ln(c), F.lit(-100.0)), F.lit(-100.0))
    return rows.agg((-F.avg(label * ln(chance) + (1 - label) * ln(1 - chance)) * weight).alias("loss"))
