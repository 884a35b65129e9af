"""Picks and samples in the order of a seeded hash: the same on every engine and every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dice(row: Column, seed: int) -> Column:
    """md5 of row:seed, the order of all picks."""
    return F.md5(F.concat(row.cast("string"), F.lit(f":{seed}")))


def ranked(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def one_per_group(df: DataFrame, group: str, row: str, seed: int = 42) -> DataFrame:
    """One row of each group. An aggregate, not a window: a hot group costs no more than its map-side combine."""
    return df.groupBy(group).agg(F.min_by(F.struct(*[c for c in df.columns if c != group]), F.struct(dice(F.col(row), seed), row)).alias("__r")).select(group, "__r.*")


def kept_else_any(df: DataFrame, group: str, flag: str, row: str, seed: int = 42) -> DataFrame:
    """One row of each group, of those with the flag if there are any."""
    order = F.struct((1 - F.col(flag)).alias("a"), dice(F.col(row), seed).alias("b"), F.col(row).alias("c"))
    return df.groupBy(group).agg(F.min_by(F.struct(*[c for c in df.columns if c != group]), order).alias("__r")).select(group, "__r.*")


def first_available(df: DataFrame, group: str, row: str, *tests: Column, seed: int = 42) -> DataFrame:
    """One row of each group: of those that pass the first test, else the second, ..., else any."""
    tier = F.lit(len(tests))
    for i, t in reversed([*enumerate(tests)]):
        tier = F.when(t, i).otherwise(tier)
    order = F.struct(tier.alias("a"), dice(F.col(row), seed).alias("b"), F.col(row).alias("c"))
    return df.groupBy(group).agg(F.min_by(F.struct(*[c for c in df.columns if c != group]), order).alias("__r")).select(group, "__r.*")


def stratified(df: DataFrame, stratum: Column, share: dict[int, float], row: str, seed: int = 42) -> DataFrame:
    """floor(share * n) rows of each stratum that has a share, all rows of the others; exact, in hash order.

    A stratum of any size: rows are counted by the first four digits of their hash, digits wholly below the cut are kept,
    and only the digit that the cut falls in is ranked.
    """
    d = df.withColumn("__s", stratum).withColumn("__h", dice(F.col(row), seed)).withColumn("__d", F.substring("__h", 1, 4))
    counts = d.groupBy("__s", "__d").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("__s").orderBy("__d")
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__all", F.sum("__n").over(Window.partitionBy("__s")))
    want = F.col("__all")
    for s, x in share.items():
        want = F.when(F.col("__s") == s, F.floor(F.col("__all") * x)).otherwise(want)
    counts = counts.withColumn("__want", want)
    d = d.join(counts, ["__s", "__d"])
    whole, cut = F.col("__before") + F.col("__n") <= F.col("__want"), F.col("__before") < F.col("__want")
    part = ranked(d.where(cut & ~whole), ["__s", "__d"], F.col("__h"), F.col(row)).where("__before + __k <= __want").drop("__k")
    return d.where(whole).unionByName(part).drop("__s", "__h", "__d", "__n", "__before", "__all", "__want")


def at_most(df: DataFrame, n: int, row: str, seed: int = 42) -> DataFrame:
    """n rows without replacement (a top-n, not a sort of all)."""
    return df.orderBy(dice(F.col(row), seed), row).limit(n)


def sorted_sample(df: DataFrame, text: str, row: str, n: int, seed: int = 42) -> DataFrame:
    """n rows as a table of samples: shuffled by hash, after a sort that the hash order makes needless."""
    return at_most(df, n, row, seed)


def wide_sample(df: DataFrame, step: int, columns: list[str], row: str, n: int, seed: int = 42) -> DataFrame:
    """One row: step, and the columns of n sampled rows side by side (column_1 ... column_n)."""
    picked = at_most(df, n, row, seed).withColumn("__h", dice(F.col(row), seed))
    rows = picked.agg(F.array_sort(F.collect_list(F.struct("__h", row, *[c for c in columns if c != row]))).alias("r"))  # n rows
    return rows.select(F.lit(step).cast("long").alias("step"), *[F.get("r", F.lit(i))[c].alias(f"{c}_{i + 1}") for i in range(n) for c in columns])


def shuffled_epoch(df: DataFrame, row: str, batch: int, seed: int = 1) -> DataFrame:
    """df in hash order, with position and batch; the rows of a last, short batch are dropped."""
    from millrace.operators.batch import numbered

    n = df.count() // batch * batch
    out = numbered(df.withColumn("__h", dice(F.col(row), seed)), "__h", row, row="position").drop("__h")
    return out.where(F.col("position") < n).withColumn("batch", F.floor(F.col("position") / batch).cast("long"))


def sharded(df: DataFrame, row: str, shards: int, seed: int = 1) -> DataFrame:
    """df with shard numbers: hash order dealt round, the remainder dropped."""
    from millrace.operators.batch import numbered

    n = df.count() // shards * shards
    out = numbered(df.withColumn("__h", dice(F.col(row), seed)), "__h", row, row="position").drop("__h")
    return out.where(F.col("position") < n).withColumn("shard", (F.col("position") % shards).cast("int"))


def top_k_mask(scores: Column, k: int) -> Column:
    """Scores of at least the k-th largest (ties stay), null for the others."""
    limit = F.get(F.sort_array(scores, asc=False), F.least(F.lit(k), F.size(scores)) - 1)
    return F.transform(F.array(limit), lambda x: F.transform(scores, lambda s: F.when(s >= x, s)))[0]
