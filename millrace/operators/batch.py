"""Verbs on batches: rows carry their position in a column row_id (0, 1, ...), since rows of a DataFrame have no order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "row_id"


def numbered(df: DataFrame, *order: str, row: str = ROW, bucket_rows: int = 1 << 20) -> DataFrame:
    """df with positions by `order`, which must be total. Rows are dealt by ranges and numbered in each; only the ranges'
    sizes meet in one task."""
    from millrace.sources.tables import materialized

    from pyspark.sql import Window

    part = materialized(df.sort(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    sizes = part.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("__part", "__first", before.alias("__start")))
    return part.join(starts, "__part").withColumn(row, F.col("__start") + F.col("__at") - F.col("__first")).drop("__part", "__at", "__first", "__start")


def select(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Chosen columns; None keeps all."""
    return df if columns is None else df.select(*columns)


def pop(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the named columns, the rest); a missing name raises."""
    if missing := [c for c in columns if c not in df.columns]:
        raise KeyError(f"no such columns: {missing}")
    return df.select(*columns), df.drop(*columns)


def rename(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("as many new names as old ones are needed")
    return df.withColumnsRenamed(dict(zip(old, new, strict=True)))


def position_faults(df: DataFrame, row: str = ROW) -> DataFrame:
    """One row: n, repeated (rows beyond the first of each position) and outside (positions beyond 0 ... n-1, and nulls)."""
    each = df.groupBy(F.col(row).alias("p")).agg(F.count(F.lit(1)).alias("k"))
    n = each.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"))
    sums = each.crossJoin(F.broadcast(n)).agg(F.sum(F.col("k") - 1).alias("repeated"), F.sum(F.when(F.col("p").isNull() | (F.col("p") < 0) | (F.col("p") >= F.col("n")), F.col("k")).otherwise(0)).alias("outside"))
    return n.crossJoin(F.broadcast(sums)).select("n", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("repeated", "outside")])  # one row each


def check_consistent(df: DataFrame, row: str = ROW) -> None:
    """Raises unless positions are 0 ... n-1, each once."""
    faults = position_faults(df, row).first()
    if faults.repeated or faults.outside:
        raise ValueError("positions are not 0 ... n-1")


def length(df: DataFrame) -> int:
    return df.count()


def column_bytes(df: DataFrame) -> DataFrame:
    """column and bytes: fixed widths, or the lengths of strings and of arrays of numbers."""
    width = {"int": 4, "bigint": 8, "double": 8, "float": 4, "boolean": 1, "smallint": 2, "tinyint": 1}

    def size(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in width:
            return F.sum(F.when(c.isNotNull(), width[kind]).otherwise(0))
        if kind.startswith("array<") and kind[6:-1] in width:
            return F.sum(F.when(c.isNotNull(), F.size(c)).otherwise(0) * width[kind[6:-1]])
        return F.sum(F.coalesce(F.octet_length(c.cast("string")), F.lit(0)))

    one = df.agg(*[F.coalesce(size(n, k), F.lit(0)).cast("long").alias(n) for n, k in df.dtypes])
    return one.unpivot([], one.columns, "column", "bytes")


def slice_rows(df: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1, row: str = ROW) -> DataFrame:
    """Rows at the positions that a Python slice has; with a negative step the same rows (positions tell their order)."""
    n = df.count() if (start or 0) < 0 or (stop or 0) < 0 or step < 0 or start is None or stop is None else max(start, stop)
    picked = range(n)[start:stop:step]
    if step < 0:
        picked = picked[::-1]
    r = F.col(row)
    return df.where((r >= picked.start) & (r < picked.stop) & ((r - picked.start) % picked.step == 0))


def take(df: DataFrame, wanted: DataFrame, row: str = ROW, position: str = "position") -> DataFrame:
    """Rows in the order and as often as in `wanted` (position, row_id); the new row_id is the position."""
    return wanted.join(df, row).drop(row).withColumnRenamed(position, row)


def mask(df: DataFrame, keep: Column) -> DataFrame:
    return df.where(keep)


def item(df: DataFrame, k: int, row: str = ROW) -> DataFrame:
    return df.where(F.col(row) == k)


def reorder(df: DataFrame, permutation: DataFrame, row: str = ROW) -> DataFrame:
    """Row p of the result is row permutation(p): permutation has position and row_id."""
    return take(df, permutation, row)


def inverse_permutation(permutation: DataFrame, position: str = "position", value: str = "value") -> DataFrame:
    """out[value] = position."""
    return permutation.select(F.col(value).alias(position), F.col(position).alias(value))


def concat(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Stacked rows; a column that the first has not raises."""
    out = first
    for r in rest:
        if extra := set(r.columns) - set(first.columns):
            raise ValueError(f"columns that the first batch has not: {sorted(extra)}")
        out = out.unionByName(r)
    return out


def union_columns(a: DataFrame, b: DataFrame, row: str = ROW) -> DataFrame:
    """The columns of both, by position; a column of both must hold equal values (null and NaN equal themselves), or a row raises."""
    both = [c for c in b.columns if c in a.columns and c != row]
    right = b.select(row, *[F.col(c).alias(f"__{c}") if c in both else F.col(c) for c in b.columns if c != row])
    joined = a.join(right, row)
    for c in both:
        joined = joined.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"__{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs")).cast(a.schema[c].dataType)))
    return joined.drop(*[f"__{c}" for c in both])


def zip_lists(a: Column, b: Column) -> Column:
    return F.arrays_zip(a, b)


def chunk(df: DataFrame, k: int, sizing: str = "ceil", row: str = ROW) -> DataFrame:
    """df with a column part. ceil: parts of ceil(n/k) rows, fewer than k of them perhaps; even: sizes that differ by one at most."""
    n = df.count()
    r = F.col(row)
    if sizing == "ceil":
        return df.withColumn("part", (F.floor(r / max(1, -(-n // k)))).cast("long"))
    q, extra = divmod(n, k)
    long = F.floor(r / (q + 1))
    return df.withColumn("part", F.when(r < extra * (q + 1), long).otherwise(extra + F.floor((r - extra * (q + 1)) / max(1, q))).cast("long"))


def fixed_chunks(df: DataFrame, size: int, row: str = ROW) -> DataFrame:
    """Parts of `size` rows, the last one shorter."""
    return df.withColumn("part", F.floor(F.col(row) / size).cast("long"))


def kth_chunk(df: DataFrame, k: int, of: int, row: str = ROW) -> DataFrame:
    return chunk(df, of, "ceil", row).where(F.col("part") == k).drop("part")


def repeat(df: DataFrame, times: int, interleave: bool = True, row: str = ROW) -> DataFrame:
    """Each row `times` times: aabb if interleaved, else abab."""
    n = None if interleave else df.count()
    out = df.withColumn("__rep", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    at = F.col(row) * times + F.col("__rep") if interleave else F.col("__rep").cast("long") * n + F.col(row)
    return out.withColumn(row, at.cast("long")).drop("__rep")


def fold(df: DataFrame, size: int, row: str = ROW) -> DataFrame:
    """Rows of `size` neighbours each, as arrays; the number of rows must be divisible."""
    if df.count() % size:
        raise ValueError("the number of rows is not divisible")
    values = [c for c in df.columns if c != row]
    g = df.groupBy(F.floor(F.col(row) / size).cast("long").alias("__g")).agg(F.array_sort(F.collect_list(F.struct(row, *values))).alias("__all"))
    return g.select(F.col("__g").alias(row), *[F.col(f"__all.{c}").alias(c) for c in values])


def unfold(df: DataFrame, size: int, row: str = ROW) -> DataFrame:
    values = [c for c in df.columns if c != row]
    out = df.select(F.col(row).alias("__g"), F.posexplode(F.arrays_zip(*values)).alias("__k", "__v"))
    return out.select((F.col("__g") * size + F.col("__k")).alias(row), *[F.col(f"__v.{c}").alias(c) for c in values])


def pad_to_divisor(df: DataFrame, divisor: int, row: str = ROW) -> tuple[DataFrame, int]:
    """Leading rows appended, again from the first if needed, until the number of rows is divisible; and how many."""
    n = df.count()
    pad = -n % divisor
    if not n or not pad:
        return df, 0
    rounds = -(-pad // n)
    again = df.withColumn("__rep", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn(row, F.col(row) + F.col("__rep").cast("long") * n)
    return df.unionByName(again.where(F.col(row) < n + pad).drop("__rep")), pad


def unpad(df: DataFrame, pad: int, times: int = 1, row: str = ROW) -> DataFrame:
    """Without the last pad * times rows."""
    return df.where(F.col(row) < df.count() - pad * times)


def minibatches(df: DataFrame, size: int, epochs: int = 1, seed: int | None = None, row: str = ROW) -> DataFrame:
    """epoch, batch and the row's columns; the number of rows must be divisible. With a seed, each epoch has its own order,
    by a hash of (seed, epoch, row_id) (numbered by ranges of it)."""
    if df.count() % size:
        raise ValueError("the number of rows is not divisible")
    each = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    if seed is None:
        return each.withColumn("batch", F.floor(F.col(row) / size).cast("long"))
    n = df.count()
    mixed = numbered(each.withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col(row).cast("string")))), "epoch", "__h", row="__n")
    return mixed.withColumn("batch", F.floor((F.col("__n") - F.col("epoch") * n) / size).cast("long")).drop("__h", "__n")


def exclude(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among those of done; Spark broadcasts done if it is small."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def distinct_answers(answers: Column) -> Column:
    return F.array_distinct(F.filter(answers, lambda a: a != ""))
