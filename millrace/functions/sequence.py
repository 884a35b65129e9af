"""Functions on token arrays: masks, padding, packing. Positions count from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scan import bound, scanned


def end_mask(ids: Column, *ends: int) -> Column:
    """1 up to and including the first end token, then 0."""
    first = F.array_min(F.transform(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: F.nullif(F.array_position(ids, e), F.lit(0).cast("long"))))
    return F.transform(F.array(F.coalesce(first, F.size(ids).cast("long"))), lambda n: F.transform(ids, lambda _, i: F.when(i < n, 1).otherwise(0)))[0]


def position_ids(mask: Column) -> Column:
    """max(running sum of the mask - 1, 0)."""
    zero = F.lit(0).cast("long")
    return scanned(mask, zero, lambda n, m: n + m.cast("long"), lambda n: F.greatest(zero, n - 1), "bigint")


def padded(ids: Column, length: int | Column, pad: int, left: bool = False) -> Column:
    """Padded to a length; longer arrays unchanged."""
    n = length if isinstance(length, Column) else F.lit(length)
    fill = F.array_repeat(F.lit(pad).cast("long"), F.greatest(F.lit(0), n - F.size(ids)).cast("int"))
    return F.concat(fill, ids) if left else F.concat(ids, fill)


def rectangular(df: DataFrame, ids: str, least: int, pad: int) -> DataFrame:
    """All arrays padded on the right to the longest, or to `least`."""
    longest = df.agg(F.greatest(F.coalesce(F.max(F.size(ids)), F.lit(0)), F.lit(least)).alias("__n"))
    return df.crossJoin(F.broadcast(longest)).withColumn(ids, padded(F.col(ids), F.col("__n"), pad)).drop("__n")


def fitted(ids: Column, length: int, pad: int, left_pad: bool = True, truncation: str = "error") -> Column:
    """Padded to a length; longer arrays keep their tail (left), their head (right) or raise."""
    long = {
        "left": F.slice(ids, F.greatest(F.lit(1), F.size(ids) - length + 1), F.lit(length)),
        "right": F.slice(ids, F.lit(1), F.lit(length)),
        "error": F.raise_error(F.concat(F.lit(f"longer than {length}: "), F.size(ids).cast("string"))).cast("array<bigint>"),
    }[truncation]
    return F.when(F.size(ids) > length, long).otherwise(padded(ids, length, pad, left_pad))


def unpadded(ids: Column, mask: Column) -> Column:
    """The last sum(mask) ids."""
    n = F.aggregate(mask, F.lit(0).cast("long"), lambda a, m: a + m.cast("long")).cast("int")
    return F.slice(ids, F.size(ids) - n + 1, n)


def from_first_token(ids: Column, pad: int) -> Column:
    """What follows leading pads."""
    first = F.array_min(F.filter(F.transform(ids, lambda x, i: F.when(x != pad, i)), lambda i: i.isNotNull()))
    return F.slice(ids, F.coalesce(first, F.size(ids)) + 1, F.size(ids))


def packed_offsets(df: DataFrame, length: str, row: str, bucket_rows: int = 1 << 16) -> DataFrame:
    """row and cu_seqlen, the sum of the lengths before it, and one row more (row = n) with the total.

    Sums of buckets of positions meet in one task, rows only with those of their bucket.
    """
    b = F.floor(F.col(row) / bucket_rows)
    d = df.select(F.col(row), F.col(length).cast("long").alias("__len"), b.alias("__b"))
    sums = d.groupBy("__b").agg(F.sum("__len").alias("__s"), F.count(F.lit(1)).alias("__c"))
    w = Window.orderBy("__b")
    offsets = sums.select("__b", (F.sum("__s").over(w) - F.col("__s")).alias("__before"))
    within = F.coalesce(F.sum("__len").over(Window.partitionBy("__b").orderBy(row).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = d.withColumn("__w", within).join(offsets, "__b").select(row, (F.col("__before") + F.col("__w")).alias("cu_seqlen"))
    return each.unionByName(sums.agg(F.sum("__c").cast(df.schema[row].dataType).alias(row), F.sum("__s").alias("cu_seqlen")))


def answer_loss_mask(mask: Column, prompt: Column) -> Column:
    """The mask without the first prompt-1 positions and without the last attended one."""
    n = F.aggregate(mask, F.lit(0).cast("long"), lambda a, m: a + m.cast("long"))
    return F.transform(F.array(n), lambda k: F.transform(mask, lambda m, i: F.when((i < prompt - 1) | (i == k - 1), 0).otherwise(m)))[0]


def joined(prompt: Column, response: Column, length: int, pad: int, truncation: str = "error") -> Column:
    """Prompt and response, padded on the right or truncated."""
    return fitted(F.concat(prompt, response), length, pad, False, truncation)


def preference_pair(prompt: Column, chosen: Column, rejected: Column, length: int, pad: int) -> Column:
    """struct(input_ids, attention_mask), each with the chosen and the rejected continuation."""
    both = [joined(prompt, x, length, pad, "right") for x in (chosen, rejected)]
    attended = lambda x: F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.when(i < F.size(prompt) + F.size(x), 1).otherwise(0))
    masks = [attended(x) for x in (chosen, rejected)]
    return F.struct(F.array(*both).alias("input_ids"), F.array(*masks).alias("attention_mask"))


def range_mask(starts: Column, ends: Column, ranges: Column) -> Column:
    """0 for tokens (their character starts and ends) that overlap one of the ranges [s, e) and begin in or after s, else 1."""
    hit = lambda a, b: F.exists(ranges, lambda r: (a >= r["s"]) & (a < r["e"]) & (b > r["s"]))
    return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda t: F.when(hit(t["a"], t["b"]), 0).otherwise(1))


def without_proposal(mask: Column, flag: Column, length: Column) -> Column:
    """The mask with its first `length` positions 0 where the flag is set and length > 0."""
    return F.transform(mask, lambda m, i: F.when((flag == 1) & (length > 0) & (i < length), 0).otherwise(m))


def response_positions(last_prompt_position: Column, length: int) -> Column:
    return F.sequence(last_prompt_position + 1, last_prompt_position + length)


def backtracked(prompt: Column, response: Column, n: int) -> Column:
    """The prompt and the response without its last n tokens."""
    return F.concat(prompt, F.slice(response, F.lit(1), F.greatest(F.lit(0), F.size(response) - n)))


def windows(tokens: Column, window: int, step: int, least: int) -> Column:
    """Windows of tokens at every step, those of fewer than `least` left out."""
    starts = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda s: F.slice(tokens, s + 1, F.lit(window))), lambda w: F.size(w) >= least)


def nearest_sorted(points: Column, to: Column) -> Column:
    """The point nearest to a position in an array in order, of two the smaller; the position itself where there is none. By halving."""
    n = F.size(points)
    bits = F.sequence(F.floor(F.log2(n.cast("double"))).cast("int"), F.lit(0), F.lit(-1))

    def step(below: Column, k: Column) -> Column:
        return bound(below + F.pow(F.lit(2.0), k).cast("int"), lambda t: F.when((t <= n) & (F.get(points, t - 1) < to), t).otherwise(below))

    def of(below: Column) -> Column:
        left, right = F.get(points, below - 1), F.get(points, below)
        return F.when(left.isNull() | (right - to < to - left), right).otherwise(left)

    return F.when(n > 0, bound(F.aggregate(bits, F.lit(0), step), of)).otherwise(to)


def snapped_windows(tokens: Column, cuts: Column, window: int, step: int, least: int) -> Column:
    """Windows at every step, each ended at the cut (a position of a token) nearest to its length, or at that length where there is
    no cut; those of fewer than `least` tokens left out. Cuts are put in order once, and each window's is found by halving."""
    starts = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))

    def of(points: Column) -> Column:
        cut = lambda s: bound(nearest_sorted(points, F.least(s + window, F.size(tokens))), lambda e: F.slice(tokens, s + 1, F.greatest(F.lit(0), e - s)))
        return F.filter(F.transform(starts, cut), lambda w: F.size(w) >= least)

    return bound(F.array_sort(F.filter(F.coalesce(cuts, F.array().cast("array<int>")), lambda c: c.isNotNull())), of)


def random_mask(n: Column, seed: Column, max_left: float = 0.3, least: float = 0.5) -> Column:
    """A mask with random left padding and a random number of valid positions, by a hash of the seed."""
    u = lambda k: F.pmod(F.xxhash64(seed, F.lit(k)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    left = F.floor(n * u(0) * max_left)
    valid = F.floor((n - left) * (least + (1 - least) * u(1)))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when((i >= left) & (i < left + valid), 1).otherwise(0))


def value_jump(df: DataFrame, row: str, values: str, tool_mask: str, reach: int = 30) -> DataFrame:
    """row and jump: the mean over runs of tool tokens (mask 0) of the mean of up to `reach` values after the run less that of
    up to `reach` before it; runs at either end of a row do not count, rows without any run give no row."""
    m, v = F.col(tool_mask), F.col(values)
    n = F.size(m)
    starts = F.filter(F.transform(m, lambda x, i: F.when((x == 0) & ((i == 0) | (F.get(m, i - 1) == 1)), i)), lambda i: i.isNotNull())
    ends = F.filter(F.transform(m, lambda x, i: F.when((x == 0) & ((i == n - 1) | (F.get(m, i + 1) == 1)), i)), lambda i: i.isNotNull())
    runs = df.select(row, v.alias("__v"), F.explode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("__r"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    after = F.slice("__v", F.col("__r.e") + 2, F.lit(reach))
    start = F.greatest(F.lit(0), F.col("__r.s") - reach)
    before = F.slice("__v", start + 1, F.col("__r.s") - start)
    inner = runs.where((F.col("__r.s") > 0) & (F.col("__r.e") < F.size("__v") - 1))
    return inner.groupBy(row).agg(F.avg(mean(after) - mean(before)).alias("jump"))
