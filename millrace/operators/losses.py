"""Losses and their schedules, as expressions on token rows and arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.groups import masked_mean


def aggregated(df: DataFrame, loss: str, mask: str, row: str, mode: str, max_length: int = 1) -> DataFrame:
    """One row `loss` of token losses: token-mean; seq-mean-token-sum; seq-mean-token-mean; seq-mean-token-sum-norm (by the padded length)."""
    v, m = F.col(loss), F.col(mask)
    if mode == "token-mean":
        return df.agg(masked_mean(v, m).alias("loss"))
    rows = df.groupBy(row).agg(F.sum(v * m).alias("s"), F.sum(m).alias("n"))
    if mode == "seq-mean-token-sum":
        return rows.agg(F.avg("s").alias("loss"))
    if mode == "seq-mean-token-mean":
        return rows.agg(F.avg(F.try_divide("s", "n")).alias("loss"))
    if mode == "seq-mean-token-sum-norm":
        return rows.agg((F.sum("s") / max_length).alias("loss"))
    raise ValueError(f"no mode {mode}")


def clipped_policy(df: DataFrame, old: str, new: str, advantage: str, mask: str, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> DataFrame:
    """policy_loss, clip_fraction, kl, clip_fraction_lower of token rows: the larger of the plain and the clipped loss, for
    negative advantages at most -A * dual."""
    delta, a = F.col(new) - F.col(old), F.col(advantage)
    ratio = F.exp(delta)
    plain, clipped = -a * ratio, -a * F.greatest(F.lit(1 - low), F.least(F.lit(1 + high), ratio))
    first, third = F.greatest(plain, clipped), -a * dual
    m = F.col(mask)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return df.agg(
        masked_mean(F.when(a < 0, F.least(third, first)).otherwise(first), m).alias("policy_loss"),
        masked_mean(flag(clipped > plain), m).alias("clip_fraction"),
        masked_mean(-delta, m).alias("kl"),
        masked_mean(flag((first > third) & (a < 0)), m).alias("clip_fraction_lower"),
    )


def clipped_value(df: DataFrame, value: str, old: str, ret: str, mask: str, clip: float = 0.5) -> DataFrame:
    """value_loss and clip_fraction: half the mean of the larger squared error, of the value and of it clipped around the old one."""
    v, o, r, m = F.col(value), F.col(old), F.col(ret), F.col(mask)
    near = F.greatest(o - clip, F.least(o + clip, v))
    a, b = F.pow(v - r, F.lit(2.0)), F.pow(near - r, F.lit(2.0))
    return df.agg((0.5 * masked_mean(F.greatest(a, b), m)).alias("value_loss"), masked_mean(F.when(b > a, 1.0).otherwise(0.0), m).alias("clip_fraction"))


def divergence(new: Column, reference: Column, kind: str) -> Column:
    """Estimates of the divergence from log-probabilities: kl, abs, mse, low_var_kl."""
    d = new - reference
    if kind == "kl":
        return d
    if kind == "abs":
        return F.abs(d)
    if kind == "mse":
        return 0.5 * d * d
    if kind == "low_var_kl":
        return F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.exp(-d) + d - 1))
    raise NotImplementedError(kind)


def log_sum_exp(logits: Column) -> Column:
    """Stable: the maximum is taken out first."""
    return F.transform(F.array(F.array_max(logits)), lambda top: top + F.ln(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))))[0]


def entropy(logits: Column) -> Column:
    """log-sum-exp less the mean logit under the softmax."""
    return F.transform(F.array(log_sum_exp(logits)), lambda z: z - F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - z) * x))[0]


def label_log_prob(logits: Column, label: Column) -> Column:
    return F.get(logits, label) - log_sum_exp(logits)


def selected_log_loss(df: DataFrame, log_prob: str, advantage: str, mask: str) -> DataFrame:
    """- sum(logp) / max(n, 1) over tokens of positive advantage."""
    on = F.when((F.col(advantage) > 1e-7) & (F.col(mask) == 1), 1.0).otherwise(0.0)
    return df.agg((-F.sum(F.col(log_prob) * on) / F.greatest(F.sum(on), F.lit(1.0))).alias("loss"))


def all_masks(*masks: Column) -> Column:
    """Positions that every mask has: product of 0/1 columns."""
    out = masks[0]
    for m in masks[1:]:
        out = out * m
    return out


def kl_shaped(score: Column, new: Column, reference: Column, beta: float, kind: str = "kl") -> Column:
    return score - beta * divergence(new, reference, kind)


def adaptive_coefficient(steps: DataFrame, order: str, kl: str, n: str, start: float, target: float, horizon: float, bucket_rows: int = 1 << 16) -> DataFrame:
    """step and coefficient after it: value *= 1 + clip(kl / target - 1, -0.2, 0.2) n / horizon, over the ordered steps of
    one run (a null kl or n changes nothing). A factor does not depend on the value before: products of buckets of steps meet in
    one task, steps only with those of their bucket."""
    from millrace.operators.batch import numbered

    factor = F.coalesce(1 + F.greatest(F.lit(-0.2), F.least(F.lit(0.2), F.col(kl) / target - 1)) * F.col(n) / horizon, F.lit(1.0))
    rows = numbered(steps.select(F.col(order).cast("long").alias("step"), factor.alias("factor")), "step", row="i").withColumn("b", F.floor(F.col("i") / bucket_rows))
    whole = rows.groupBy("b").agg(F.product("factor").alias("p"))
    before = F.coalesce(F.product("p").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    within = F.product("factor").over(Window.partitionBy("b").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("within", within).join(whole.select("b", before.alias("before")), "b").select("step", (start * F.col("before") * F.col("within")).alias("coefficient"))


def cosine_factor(step: Column, steps: int, warmup: int, floor: float = 0.0, cycles: float = 0.5) -> Column:
    """The learning rate's factor at a step (from 0): linear warm-up, then a cosine between 1 and the floor."""
    s = step.cast("double")
    progress = (s - warmup) / max(1, steps - warmup)
    wave = (1 - floor) / 2 * F.cos(F.lit(math.pi * cycles * 2) * progress) + (1 + floor) / 2
    return F.when(s < warmup, s / max(1, warmup)).otherwise(F.greatest(F.lit(0.0), wave))


def constant_factor(step: Column, warmup: int) -> Column:
    """Linear warm-up, then 1."""
    return F.least(F.lit(1.0), step.cast("double") / max(1, warmup))


def cosine_schedule(spark: SparkSession, steps: int, warmup: int, floor: float = 0.0, cycles: float = 0.5) -> DataFrame:
    """step and factor of all steps."""
    return spark.range(steps).select(F.col("id").alias("step"), cosine_factor(F.col("id"), steps, warmup, floor, cycles).alias("factor"))


def constant_schedule(spark: SparkSession, steps: int, warmup: int) -> DataFrame:
    return spark.range(steps).select(F.col("id").alias("step"), constant_factor(F.col("id"), warmup).alias("factor"))
