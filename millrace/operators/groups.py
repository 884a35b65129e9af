"""Aggregates and group-wise filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def masked_mean(value: Column, mask: Column) -> Column:
    """Aggregate: sum(v m) / sum(m); null for an empty mask."""
    return F.try_divide(F.sum(value * mask), F.sum(mask))


def masked_var(value: Column, mask: Column) -> Column:
    """Aggregate: the sample variance where the mask is 1; raises if it is 1 fewer than two times."""
    n = F.sum(mask)
    return F.when(n < 2, F.raise_error(F.lit("a variance needs two values")).cast("double")).otherwise(F.var_samp(F.when(mask == 1, value)))


def whitened(df: DataFrame, value: str, mask: str, shift_mean: bool = True, out: str = "whitened") -> DataFrame:
    """(v - mean) / sqrt(var + 1e-8) over the whole batch; without shift_mean the mean is added again. One row of statistics is broadcast."""
    stats = df.agg(masked_mean(F.col(value), F.col(mask)).alias("__m"), masked_var(F.col(value), F.col(mask)).alias("__v"))
    x = (F.col(value) - F.col("__m")) / F.sqrt(F.col("__v") + 1e-8)
    return df.crossJoin(F.broadcast(stats)).withColumn(out, x if shift_mean else x + F.col("__m")).drop("__m", "__v")


def group_variance(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Rows of groups whose metric varies, and of groups of one row."""
    g = df.groupBy(group).agg(F.stddev_pop(metric).alias("__sd"), F.count(F.lit(1)).alias("__n")).where("__sd > 0 OR __n = 1").select(group)
    return df.join(g, group, "left_semi")


def keep_flags(df: DataFrame, group: str, flag: str, ratio: float, out: str = "kept") -> DataFrame:
    """The flag, or 0 for a whole group with fewer flags than ceil(ratio * n)."""
    g = df.groupBy(group).agg(F.sum(flag).alias("__k"), F.count(F.lit(1)).alias("__n"))
    return df.join(g, group).withColumn(out, F.when(F.col("__k") >= F.ceil(F.col("__n") * F.lit(ratio)), F.col(flag)).otherwise(0)).drop("__k", "__n")


def row_flag(passes: Column, length: Column, boxed: Column, text: Column, optimised: Column, least: int = 150, by_passes: bool = True, by_length: bool = True, by_box: bool = True) -> Column:
    """1 for a row whose calls all passed (1), that is longer than `least` tokens and holds a box near its end, as far as each is
    asked; a row of pass-rate optimisation needs a fence in its last 200 characters instead."""
    parts = [c for c, asked in ((passes == 1, by_passes), (length > least, by_length), (boxed, by_box)) if asked]
    good = F.lit(True)
    for c in parts:
        good &= F.coalesce(c, F.lit(False))
    fenced = F.contains(F.right(text, F.lit(200)), F.lit("```"))
    return F.when(F.when(F.coalesce(optimised, F.lit(0)) == 1, F.coalesce(fenced, F.lit(False))).otherwise(good), 1).otherwise(0)


def skipped(df: DataFrame, flag: str, batch: str) -> DataFrame:
    """Batches none of whose rows has the flag: an update skips them."""
    return df.groupBy(batch).agg(F.max(F.when(F.col(flag) == 1, 1).otherwise(0)).alias("any")).where("any = 0").select(batch)


def outcome_ratios(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Shares of groups that are all right, all wrong and mixed; uniformly negative groups are none of these."""
    g = df.groupBy(group).agg(F.stddev_pop(metric).alias("sd"), F.sum(metric).alias("s"))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    sd, s = F.col("sd"), F.col("s")
    return g.agg(share((sd == 0) & (s > 0)).alias("all_true"), share((sd == 0) & (s == 0)).alias("all_false"), share(sd > 0).alias("mixed"))


#: Data sets that accuracies are reported for, by a part of their source's name; the first that fits counts (fixed values).
DATA_SETS = ["MATH", "LiveMathBench", "AIME_2024", "AIME_2025", "amc_2023"]


def prefix_accuracy(df: DataFrame, source: str, reward: str, prefixes: list[str] = DATA_SETS) -> DataFrame:
    """prefix, true_num, total_num, accuracy by the first prefix that a source holds; sources with none are dropped, prefixes
    without rows are 0."""
    hit = F.lit(None).cast("string")
    for p in reversed(prefixes):
        hit = F.when(F.contains(F.col(source), F.lit(p)), p).otherwise(hit)
    got = df.groupBy(hit.alias("prefix")).agg(F.sum(reward).alias("t"), F.count(F.lit(1)).alias("n"))
    all_ = df.sparkSession.createDataFrame([(p,) for p in prefixes], "prefix string")
    t, n = F.coalesce("t", F.lit(0.0)), F.coalesce("n", F.lit(0))
    return F.broadcast(all_).join(got, "prefix", "left").select("prefix", t.alias("true_num"), n.alias("total_num"), (t / F.greatest(n, F.lit(1))).alias("accuracy"))


def macro_mean(df: DataFrame, source: str, reward: str) -> DataFrame:
    """Means by source, and under the source `all` the mean of them."""
    g = df.groupBy(F.col(source).alias("source")).agg(F.avg(reward).alias("mean"))
    return g.unionByName(g.agg(F.lit("all").alias("source"), F.avg("mean").alias("mean")))


def source_lengths(df: DataFrame, source: str, length: str, reward: str) -> DataFrame:
    """Mean length by source, and that of right responses; null where none is right."""
    right = F.sum(F.when(F.col(reward) == 1, F.col(length)).otherwise(0))
    return df.groupBy(F.col(source).alias("source")).agg(F.avg(length).alias("mean_length"), F.try_divide(right, F.nullif(F.sum(reward), F.lit(0.0))).alias("right_length"))


def pass_at_k(df: DataFrame, scores: str) -> DataFrame:
    """The share of rows whose largest score is 1."""
    return df.agg(F.avg(F.when(F.array_max(scores) == 1, 1.0).otherwise(0.0)).alias("pass_at_k"))


def call_histogram(df: DataFrame, calls: str, top: int = 7) -> DataFrame:
    return df.groupBy(F.least(F.col(calls), F.lit(top)).alias("calls")).agg(F.count(F.lit(1)).alias("n"))


#: Upper bounds of length buckets and their names.
LENGTHS = [(2000, "<2000"), (5000, "2000~5000"), (8000, "5000~8000"), (11000, "8000~11000"), (14000, "11000~14000")]


def length_bucket(n: Column) -> Column:
    out = F.lit(">14000")
    for most, name in reversed(LENGTHS):
        out = F.when(n < most, name).otherwise(out)
    return out


def length_histogram(df: DataFrame, length: str) -> DataFrame:
    """All buckets, those without rows as 0."""
    all_ = df.sparkSession.createDataFrame([(n,) for _, n in LENGTHS] + [(">14000",)], "bucket string")
    got = df.groupBy(length_bucket(F.col(length)).alias("bucket")).agg(F.count(F.lit(1)).alias("k"))
    return F.broadcast(all_).join(got, "bucket", "left").select("bucket", F.coalesce("k", F.lit(0)).cast("long").alias("n"))


def distinct_groups(df: DataFrame, group: str) -> DataFrame:
    return df.agg(F.countDistinct(group).alias("groups"))


def group_lists(df: DataFrame, group: str, metric: str) -> DataFrame:
    """The sorted values of each group (groups are prompts' samples: a few dozen rows)."""
    return df.groupBy(group).agg(F.array_sort(F.collect_list(metric)).alias("values"))


def metric_means(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("metric")).agg(F.avg(value).alias("mean"))


def metric_segments(df: DataFrame, key: str, value: str, order: str, size: int = 10_000) -> DataFrame:
    """metric, segment (from 0) and values: each metric's values in order (which must be total in a metric), in lists of `size` at
    most, so that no metric, however long its history, is one array or one task."""
    from millrace.operators.batch import numbered

    rows = numbered(df.select(F.col(key).alias("metric"), F.col(order).alias("o"), F.col(value).alias("v")), "metric", "o", row="i")
    first = rows.groupBy(F.col("metric").alias("k")).agg(F.min("i").alias("first"))
    at = rows.join(first, F.col("metric").eqNullSafe(F.col("k"))).select("metric", "o", "v", F.floor((F.col("i") - F.col("first")) / size).alias("segment"))
    return at.groupBy("metric", "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "v"))), lambda x: x["v"]).alias("values"))


def metric_lists(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Values of each metric in order, in one list (metric_segments: in bounded ones)."""
    return df.groupBy(F.col(key).alias("metric")).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("values"))


def data_metrics(rows: DataFrame, tokens: DataFrame, max_length: int) -> DataFrame:
    """metric and value in long form: mean, max and min of scores, lengths and token values, clip ratio and explained variance.

    rows: score, length; tokens: advantage, ret (return), value of attended positions.
    """
    stats = lambda c: [F.avg(c).alias(f"{c}/mean"), F.max(c).cast("double").alias(f"{c}/max"), F.min(c).cast("double").alias(f"{c}/min")]
    clip = F.avg(F.when(F.col("length") >= max_length, 1.0).otherwise(0.0)).alias("length/clip_ratio")
    a = rows.agg(*stats("score"), *stats("length"), clip)
    explained = (1 - F.var_samp(F.col("ret") - F.col("value")) / (F.var_samp("ret") + 1e-5)).alias("value/explained_var")
    b = tokens.agg(*stats("advantage"), *stats("ret"), *stats("value"), explained)
    return a.unpivot([], a.columns, "metric", "value").unionByName(b.unpivot([], b.columns, "metric", "value"))


def timing_per_token(timings: DataFrame, tokens: DataFrame) -> DataFrame:
    """name and ms_per_token of timings (name, seconds): gen by response tokens, all others by all tokens (one row: response, total)."""
    n = F.when(F.col("name") == "gen", F.col("response")).otherwise(F.col("total"))
    return timings.crossJoin(F.broadcast(tokens)).select("name", (F.col("seconds") * 1000 / n).alias("ms_per_token"))


def balance_statistics(df: DataFrame, length: str, parts: int, part: str, row: str) -> DataFrame:
    """Minimum, maximum, spread and mean of the parts' sums: before (windows of n // k rows; a remainder is one more window,
    the mean is by k) and after (by the column part)."""
    n = df.count()
    before = df.groupBy(F.floor(F.col(row) / max(1, n // parts)).alias("g")).agg(F.sum(length).alias("s"))
    after = df.groupBy(F.col(part).alias("g")).agg(F.sum(length).alias("s"))
    stat = lambda d, name: d.agg(F.lit(name).alias("when"), F.min("s").alias("least"), F.max("s").alias("most"), (F.max("s") - F.min("s")).alias("spread"), (F.sum("s") / parts).alias("mean"))
    return stat(before, "before").unionByName(stat(after, "after"))


def dense_flops(df: DataFrame, length: str, parameters: int, layers: int, heads: int, head_size: int, seconds: float) -> DataFrame:
    """TFLOPS of a dense decoder: (6 N sum(len) + 12 sum(len^2) head_size heads layers) / seconds / 1e12."""
    n = F.col(length).cast("double")
    return df.agg(((6.0 * parameters * F.sum(n) + 12.0 * F.sum(n * n) * head_size * heads * layers) / seconds / 1e12).alias("tflops"))


def masked_loss(df: DataFrame, loss: str, mask: str, ranks: int = 1) -> DataFrame:
    return df.agg((masked_mean(F.col(loss), F.col(mask)) * ranks).alias("loss"))


def keys_of_group(df: DataFrame, group: str, *columns: Column) -> DataFrame:
    w = Window.partitionBy(group)
    return df.select("*", *[c.over(w) for c in columns])
