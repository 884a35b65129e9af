"""Advantages: of rows by group statistics, of tokens by recursions over arrays in reverse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scan import bound, scanned_back

EPSILON = 1e-6


def by_group(df: DataFrame, group: str, *aggregates: Column) -> DataFrame:
    """df with aggregates of each row's group: a join with an aggregate, so that a hot group is summed on the map side and
    Spark may broadcast the aggregates or split a skewed side."""
    return df.join(df.groupBy(group).agg(*aggregates), group)


def group_relative(df: DataFrame, group: str, score: str, out: str = "advantage") -> DataFrame:
    """(s - mean) / (sample deviation + 1e-6); a single row has mean 0 and deviation 1."""
    g = by_group(df, group, F.avg(score).alias("__m"), F.stddev_samp(score).alias("__sd"), F.count(F.lit(1)).alias("__n"))
    one = F.col("__n") == 1
    x = (F.col(score) - F.when(one, 0.0).otherwise(F.col("__m"))) / (F.when(one, 1.0).otherwise(F.col("__sd")) + EPSILON)
    return g.withColumn(out, x).drop("__m", "__sd", "__n")


def leave_one_out(df: DataFrame, group: str, score: str, out: str = "advantage") -> DataFrame:
    """s n/(n-1) - mean n/(n-1); a single row unchanged."""
    g = by_group(df, group, F.avg(score).alias("__m"), F.count(F.lit(1)).alias("__n"))
    n = F.col("__n")
    x = F.when(n > 1, (F.col(score) - F.col("__m")) * n / F.when(n > 1, n - 1).otherwise(1)).otherwise(F.col(score))
    return g.withColumn(out, x).drop("__m", "__n")


def suffix_sums(rewards: Column, mask: Column) -> Column:
    """Sums of the masked rewards from each position on."""
    return scanned_back(F.arrays_zip(rewards.alias("r"), mask.alias("m")), F.lit(0.0), lambda s, x: s + x["r"] * x["m"], lambda s: s)


def greedy_baseline(rewards: Column, mask: Column, baseline: Column) -> Column:
    """Suffix sums less the baseline, where the mask is 1: struct(returns, advantages)."""
    r = suffix_sums(rewards, mask)
    return F.transform(F.array(r), lambda x: F.struct(x.alias("returns"), F.zip_with(x, mask, lambda v, m: v - baseline * m).alias("advantages")))[0]


def discounted(rewards: Column, mask: Column, gamma: float) -> Column:
    """R_t = r_t + gamma R_{t+1}, the carry cut after positions where the mask is 0."""
    start = F.struct(F.lit(0.0).alias("r"), F.lit(0.0).alias("carry"))
    step = lambda s, x: bound(x["r"] + F.lit(gamma) * s["carry"], lambda r: F.struct(r.alias("r"), (r * x["m"]).alias("carry")))
    return scanned_back(F.arrays_zip(rewards.alias("r"), mask.alias("m")), start, step, lambda s: s["r"])


def gae(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages: delta_t = r_t + gamma V_{t+1} - V_t, A_t = delta_t + gamma lam A_{t+1}. Not yet whitened."""
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("v"))
    step = lambda s, x: F.struct((x["r"] + F.lit(gamma) * s["v"] - x["v"] + F.lit(gamma * lam) * s["a"]).alias("a"), x["v"].alias("v"))
    return scanned_back(F.arrays_zip(rewards.alias("r"), values.alias("v")), start, step, lambda s: s["a"])


def settled_values(values: Column, tool_mask: Column) -> Column:
    """Values of tool tokens (mask 0) replaced by the next one's, from the end."""
    return scanned_back(F.arrays_zip(values.alias("v"), tool_mask.alias("m")), F.lit(0.0), lambda s, x: F.when(x["m"] == 0, s).otherwise(x["v"]), lambda s: s)


def skipping_gae(rewards: Column, settled: Column, tool_mask: Column, gamma: float, lam: Column) -> Column:
    """gae over settled values, where tool tokens hand on the advantage after them unchanged."""
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("v"))

    def step(s: Column, x: Column) -> Column:
        new = x["r"] + F.lit(gamma) * s["v"] - x["v"] + F.lit(gamma) * lam * s["a"]
        return F.struct(F.when(x["m"] == 0, s["a"]).otherwise(new).alias("a"), x["v"].alias("v"))

    return scanned_back(F.arrays_zip(rewards.alias("r"), settled.alias("v"), tool_mask.alias("m")), start, step, lambda s: s["a"])


def policy_lambda(length: Column, alpha: float, least: float = 0.9) -> Column:
    """max(1 - 1 / max(alpha len, 1), least)."""
    return F.greatest(1 - 1 / F.greatest(F.lit(alpha) * length, F.lit(1.0)), F.lit(least))


def decoupled_gae(df: DataFrame, rewards: str, values: str, tool_mask: str, gamma: float, lam: float, alpha: float) -> DataFrame:
    """df with returns (targets of the value, by lam) and advantages (of the policy, by a lambda that grows with the length). Not yet whitened."""
    d = df.withColumn("__v", settled_values(F.col(values), F.col(tool_mask)))
    r, v, m = F.col(rewards), F.col("__v"), F.col(tool_mask)
    target = skipping_gae(r, v, m, gamma, F.lit(lam))
    d = d.withColumn("returns", F.zip_with(target, v, lambda a, b: a + b))
    return d.withColumn("advantages", skipping_gae(r, v, m, gamma, policy_lambda(F.size(rewards).cast("double"), alpha))).drop("__v")


def whitened_tokens(df: DataFrame, array: str, mask: str) -> DataFrame:
    """An array column whitened over all attended tokens of the batch, and masked.

    One aggregate of each row's count, mean and squared deviations from that mean (one row, broadcast); no token is exploded.
    """
    pairs = F.filter(F.zip_with(array, mask, lambda a, m: F.when(m == 1, a)), lambda x: x.isNotNull())
    n = F.size(pairs)
    mean = bound(pairs, lambda p: F.when(F.size(p) > 0, F.aggregate(p, F.lit(0.0), lambda s, x: s + x) / F.size(p)))
    rows = df.select(n.alias("n"), mean.alias("mean"), pairs.alias("x")).select("n", "mean", F.aggregate("x", F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean"))).alias("square"))
    all_, centre = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    square = F.sum("square") + F.sum(F.col("n") * F.col("mean") * F.col("mean")) - all_ * centre * centre
    stats = rows.agg(centre.alias("__mean"), (F.greatest(F.lit(0.0), square) / F.when(all_ > 1, all_ - 1)).alias("__var"))
    white = F.zip_with(array, mask, lambda a, m: (a - F.col("__mean")) / F.sqrt(F.col("__var") + 1e-8) * m)
    return df.crossJoin(F.broadcast(stats)).withColumn(array, white).drop("__mean", "__var")


#: Estimators by name; those that need a value function.
ESTIMATORS = ("group_relative", "leave_one_out", "greedy_baseline", "discounted", "gae", "decoupled_gae")
WITH_VALUES = ("gae", "decoupled_gae")


def advantages(df: DataFrame, estimator: str, gamma: float = 1.0, lam: float = 1.0, alpha: float = 0.05) -> DataFrame:
    """df (uid, score, rewards, mask, and as needed values, tool_mask, baseline) with advantages (and returns) by an estimator's name."""
    m = F.col("mask")
    if estimator in ("group_relative", "leave_one_out"):
        f = group_relative if estimator == "group_relative" else leave_one_out
        return f(df, "uid", "score", "__a").withColumn("advantages", F.transform("mask", lambda x: F.col("__a") * x)).withColumn("returns", F.col("advantages")).drop("__a")
    if estimator == "greedy_baseline":
        return df.withColumn("__g", greedy_baseline(F.col("rewards"), m, F.col("baseline"))).select("*", "__g.*").drop("__g")
    if estimator == "discounted":
        d = df.withColumn("returns", discounted(F.col("rewards"), m, gamma))
        return whitened_tokens(d.withColumn("advantages", F.col("returns")), "advantages", "mask")
    if estimator == "gae":
        d = df.withColumn("advantages", gae(F.col("rewards"), F.col("values"), gamma, lam))
        d = d.withColumn("returns", F.zip_with("advantages", "values", lambda a, v: a + v))
        return whitened_tokens(d, "advantages", "mask")
    if estimator == "decoupled_gae":
        return whitened_tokens(decoupled_gae(df, "rewards", "values", "tool_mask", gamma, lam, alpha), "advantages", "mask")
    raise ValueError(f"no estimator {estimator}; there are {', '.join(ESTIMATORS)}")
