"""Reward operators on step tables: a row for each step, keyed by a trajectory and ordered by a step number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragloom.functions import text as X
from ragloom.session import fresh

# Initial gate, and conclusions that abstain rather than contradict.
GATE_WEIGHTS, GATE_BIAS, GATE_TAU, LEAST_TAU = (1.0, 1.5, -0.8), -2.0, 0.5, 0.1
ABSTENTION = (
    r"(?i)\b(no information|no info|not available|not contain|does not contain|doesn't contain|no matching|not found|cannot (be )?(determine|found|answer)|"
    r"can't (determine|find|answer)|unknown|insufficient|lacks?|lacking|no (relevant |retrieved )?(passage|information|data|triple|entry)|"
    r"not (mention|state|provide|specify|about|the same|directly)|no suitable|no evidence|not identified|does not (directly )?(link|relate|connect|indicate)|unable to|"
    r"(is|are|was|were) not (available|found|mentioned|specified|present|clear|known|listed|given|identified|provided|stated|the same|directly|in (the |this )?"
    r"(graph|kg|knowledge graph|subgraph|passage|context|data)))\b"
)


def alpha(density: Column, confidence: Column, entropy: Column, weights: tuple[float, ...] = GATE_WEIGHTS, bias: float = GATE_BIAS, tau: float = GATE_TAU) -> Column:
    """The gate: a sigmoid of the weighted features over a temperature of at least ``LEAST_TAU``."""
    z = (F.lit(weights[0]) * density + F.lit(weights[1]) * confidence + F.lit(weights[2]) * entropy + F.lit(bias)) / F.lit(max(tau, LEAST_TAU))
    return 1.0 / (1.0 + F.exp(-z))


def entropy(logprobs: Column) -> Column:
    """Minus the mean log-probability, at least 0; 1 where there is none."""
    mean = F.aggregate(logprobs, F.lit(0.0), lambda s, x: s + x) / F.size(logprobs)
    return F.when(logprobs.isNull() | (F.size(logprobs) == 0), 1.0).otherwise(F.greatest(F.lit(0.0), -mean))


def text_reward(nll: Column) -> Column:
    return F.tanh((F.lit(2.5) - nll) / F.lit(1.5))


def step_total(a: Column, kg: Column, text: Column, text_scale: float = 1.0, step_scale: float = 1.0) -> Column:
    return (a * kg + (F.lit(1.0) - a) * text * F.lit(text_scale)) * F.lit(step_scale)


def contradicts(conclusion: Column, earlier: Column) -> Column:
    """Whether one of the two is negated and they share two words of four letters or more."""
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b\w{4,}\b"), F.lit(0)))
    negated = lambda c: F.rlike(F.lower(c), F.lit(X.NEGATION))
    return (F.size(F.array_intersect(tokens(conclusion), tokens(earlier))) >= 2) & (negated(conclusion) != negated(earlier))


def is_contradiction(conclusion: Column, earlier: Column) -> Column:
    """``contradicts`` for any of the array ``earlier``, unless the conclusion abstains."""
    found = F.exists(earlier, lambda p: contradicts(conclusion, p))
    return F.coalesce((conclusion != "") & ~conclusion.rlike(ABSTENTION) & found, F.lit(False))


def step_label(cited: Column, verified: Column, relevant: Column, graph: Column, contradiction: Column, discourse: Column, least_graph: int = 3) -> Column:
    """Label of a step from its counts: citations, verified and relevant ones, and triples in the graph.

    Without citations only a contradiction counts, and a discourse step never does; a sparse graph says nothing; a contradiction
    dominates; else the label is precision times relevance.
    """
    share = (verified / cited) * (relevant / cited)
    uncited = F.when(discourse, 0.0).when(contradiction, -1.0).otherwise(0.0)
    return F.when(cited == 0, uncited).when(graph < least_graph, 0.0).when(contradiction, -1.0).otherwise(share)


def outcome_adjusted(steps: DataFrame, outcomes: DataFrame, weight: float = 10.0) -> DataFrame:
    """Adds ``weight`` times the exact match to the last step of a valid trajectory, takes ``weight`` off that of an invalid one.

    An invalid trajectory without steps gets a step 0. ``steps``: key, step, reward; ``outcomes``: key, valid, em.
    """
    last = Window.partitionBy("key").orderBy(F.col("step").desc())
    rows = outcomes.join(steps.withColumn("back", F.row_number().over(last)), "key", "left")
    extra = F.when(F.coalesce("back", F.lit(1)) != 1, 0.0).when(F.col("valid"), F.lit(weight) * F.coalesce("em", F.lit(0.0))).otherwise(-F.lit(weight))
    rows = rows.where("step is not null or not valid")
    return rows.select("key", F.coalesce("step", F.lit(0)).alias("step"), (F.coalesce("reward", F.lit(0.0)) + extra).alias("reward"))


#: Places that a round of ``discounted_returns`` adds up.
FAN = 8


def discounted_returns(steps: DataFrame, gamma: float, key: str = "key", order: str = "step", reward: str = "reward", out: str = "ret") -> DataFrame:
    """R_t = r_t + gamma R_{t+1}, over the rest of the trajectory, for a gamma from 0 to 1. A null reward counts as 0.

    Sums over windows of ``FAN`` times the length in each round: the sum of the next 8 s rewards is that of 8 windows of s, each times a power of gamma to the s. All rounds share one
    sort, and there are as many as it takes for the power to be 0 as a double (6 for 0.99), whatever a trajectory's length is. Nothing is divided.
    """
    if not 0 <= gamma <= 1:
        raise ValueError("gamma must be from 0 to 1")
    value = F.coalesce(F.col(reward).cast("double"), F.lit(0.0))
    if gamma == 1:
        return steps.withColumn(out, F.sum(value).over(Window.partitionBy(key).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)))
    along, length, rows = Window.partitionBy(key).orderBy(order), 1, steps.withColumn(out, value)
    while power := gamma**length:
        ahead = [F.lit(power**j) * F.coalesce(F.lead(out, j * length).over(along), F.lit(0.0)) for j in range(1, FAN) if power**j]
        rows, length = rows.withColumn(out, sum(ahead, F.col(out))), length * FAN
    return rows


def gae(steps: DataFrame, gamma: float, lam: float, key: str = "key", order: str = "step") -> DataFrame:
    """Generalised advantages: deltas with the next value (0 after the last), discounted by gamma * lambda."""
    nxt = F.coalesce(F.lead("value").over(Window.partitionBy(key).orderBy(order)), F.lit(0.0))
    delta = fresh("delta", steps)
    deltas = steps.withColumn(delta, F.col("reward") + F.lit(gamma) * nxt - F.col("value"))
    return discounted_returns(deltas, gamma * lam, key, order, delta, "advantage").drop(delta)


def whitened(rows: DataFrame, column: str, mask: Column | None = None, eps: float = 1e-8) -> DataFrame:
    """``column`` shifted and scaled to mean 0 and deviation 1 over the masked rows; one global aggregate, no window over all rows."""
    kept = rows if mask is None else rows.where(mask)
    mean, var = fresh("mean", rows), fresh("var", rows)
    whole = kept.agg(F.avg(column).alias(mean), F.var_samp(column).alias(var))
    return rows.crossJoin(F.broadcast(whole)).withColumn("whitened", (F.col(column) - F.col(mean)) / F.sqrt(F.col(var) + F.lit(eps))).drop(mean, var)


def group_advantage(rows: DataFrame, group: str, reward: str) -> DataFrame:
    """(r - mean) / (std + 1e-6) within each group, joined from an aggregate so that a large group is spread."""
    mean, std = fresh("mean", rows), fresh("std", rows)
    stats = rows.groupBy(group).agg(F.avg(reward).alias(mean), F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias(std))
    return rows.join(stats, group).withColumn("advantage", (F.col(reward) - F.col(mean)) / (F.col(std) + F.lit(1e-6))).drop(mean, std)


def spans(headers: DataFrame, key: str, start: str, end: Column) -> DataFrame:
    """Each header's span: from its start to the next one's, the last to ``end``."""
    return headers.withColumn("stop", F.coalesce(F.lead(start).over(Window.partitionBy(key).orderBy(start)), end))


def span_means(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """Mean log-probability of the tokens in each span: tokens (key, i, logprob), spans (key, step, start, stop)."""
    rows = spans.join(tokens, (spans["key"] == tokens["key"]) & (F.col("i") >= F.col("start")) & (F.col("i") < F.col("stop")), "left")
    return rows.groupBy(spans["key"], "step").agg(F.avg("logprob").alias("mean_logprob"), F.count("logprob").alias("n_tokens"))
