"""Balanced parts: placement by length as an operator."""

from __future__ import annotations

import heapq
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.tables import materialized

#: Rows that one task balances at once, at most.
BLOCK = 1 << 15


def differencing(lengths: list[int], parts: int, equal_size: bool = False) -> list[list[int]]:
    """Indices in `parts` parts of like sums, by largest differencing: partial partitions wait in a heap by their spread,
    and the two of the largest spread are merged, heaviest parts with lightest. With equal_size all parts have as many items
    (their number must be divisible). Parts in the making are a sum, the first item and a tree of items: merging copies none."""
    n = len(lengths)
    if n < parts:
        raise ValueError("there are fewer items than parts")
    order = sorted(range(n), key=lambda i: (lengths[i], i))
    if equal_size:
        if n % parts:
            raise ValueError("the number of items is not divisible")
        states = [[(-lengths[i], i, i) for i in order[k : k + parts]] for k in range(0, n, parts)]
    else:
        states = [[(0, -1, None)] * (parts - 1) + [(-lengths[i], i, i)] for i in order]
    heap = []
    for serial, s in enumerate(states):
        s = sorted(s, key=itemgetter(0, 1))
        heapq.heappush(heap, (s[0][0] - s[-1][0], serial, s))
    serial = len(states)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        merged = sorted([y if x[1] < 0 else x if y[1] < 0 else (x[0] + y[0], x[1], (x[2], y[2])) for x, y in zip(a, reversed(b), strict=True)], key=itemgetter(0, 1))
        heapq.heappush(heap, (merged[0][0] - merged[-1][0], serial, merged))
        serial += 1
    return [sorted(_items(p[2])) for p in heap[0][2]]


def _items(tree) -> list[int]:
    """The items of a tree of pairs, of any depth."""
    out, todo = [], [] if tree is None else [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            todo += x
        else:
            out.append(x)
    return out


def greedy(lengths: list[int], parts: int) -> list[list[int]]:
    """Each item in turn to the lightest part (ties: the first)."""
    heap = [(0, k) for k in range(parts)]
    out: list[list[int]] = [[] for _ in range(parts)]
    for i, x in enumerate(lengths):
        s, k = heapq.heappop(heap)
        out[k].append(i)
        heapq.heappush(heap, (s + x, k))
    return out


def balanced(df: DataFrame, batch: str, length: str, row: str, parts: int, equal_size: bool = False, method: str = "differencing") -> DataFrame:
    """df with part_id, each batch (the rows of one training step) balanced over `parts` parts. Batches are dealt over the cluster;
    only the size of the largest comes to the driver.

    A batch of more than BLOCK rows is balanced in blocks, and the blocks' parts are joined by differencing, heaviest with
    lightest: the spread of what is joined is no more than the larger of both, so that parts differ by the longest row at most, as
    within a block. With equal_size blocks leave out up to parts - 1 rows each, which are balanced as a batch of their own.
    """
    ids = df.select(F.col(f"`{batch}`").alias("batch"), F.col(f"`{row}`").alias("row"), F.col(f"`{length}`").alias("length"))
    sizes = ids.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    found = _blocks(ids.withColumn("block", F.lit(0)), parts, equal_size, method) if most <= BLOCK else _joined(ids, sizes, parts, equal_size, method)
    placed = found.select(F.col("batch").alias(batch), F.col("row").alias(row), "part_id")
    return df.join(placed, [batch, row])


def _blocks(ids: DataFrame, parts: int, equal_size: bool, method: str, leave: bool = False) -> DataFrame:
    """batch, block, row, length and part_id of each block by itself; -1 where `leave` keeps rows out, so that the others are divisible."""

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row").reset_index(drop=True)
        lengths, part = pdf["length"].tolist(), [-1] * len(pdf)
        if leave:
            lengths = lengths[: len(lengths) // parts * parts]
        k = min(parts, len(lengths))
        found = (differencing(lengths, k, equal_size) if method == "differencing" else greedy(lengths, k)) if k else []
        for k, idx in enumerate(sorted(found)):
            for i in idx:
                part[i] = k
        return pdf.assign(part_id=part)

    kinds = dict(ids.dtypes)
    return ids.groupBy("batch", "block").applyInPandas(deal, ", ".join(f"{c} {kinds[c]}" for c in ids.columns) + ", part_id int")


def _joined(ids: DataFrame, sizes: DataFrame, parts: int, equal_size: bool, method: str) -> DataFrame:
    """batch, row and part_id of batches of any size: blocks by the row's hash, written once, then the blocks' parts joined."""
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    if equal_size and sizes.where(F.col("n") % parts != 0).limit(1).count():
        raise ValueError("the number of items is not divisible")
    cut = ids.join(sizes.drop("n"), "batch").withColumn("block", F.pmod(F.xxhash64("row"), "blocks").cast("int")).select("batch", "row", "length", "block")
    found = materialized(_blocks(cut, parts, equal_size, method, leave=equal_size), "blocks")
    if equal_size and not (left := found.where("part_id < 0")).isEmpty():
        rest = left.withColumn("block", F.lit(-1)).drop("part_id")
        found = found.where("part_id >= 0").unionByName(materialized(_blocks(rest, parts, True, method), "rest"))
    sums = found.groupBy("batch", "block", "part_id").agg(F.sum("length").alias("length"))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        heap = []
        for serial, (block, g) in enumerate(pdf.sort_values(["block", "part_id"]).groupby("block")):
            part = [(-n, p, (block, p)) for n, p in zip(g["length"].tolist(), g["part_id"].tolist(), strict=True)]
            part = sorted(part + [(0, p, None) for p in range(len(part), parts)], key=itemgetter(0, 1))
            heapq.heappush(heap, (part[0][0] - part[-1][0], serial, [(n, p, None if at is None else [at]) for n, p, at in part]))
        serial = len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
            merged = sorted([(x[0] + y[0], min(x[1], y[1]), (x[2] or []) + (y[2] or [])) for x, y in zip(a, reversed(b), strict=True)], key=itemgetter(0, 1))
            heapq.heappush(heap, (merged[0][0] - merged[-1][0], serial, merged))
            serial += 1
        rows = [(pdf["batch"].iloc[0], block, p, k) for k, (_, _, at) in enumerate(heap[0][2]) for block, p in at or []]
        return pd.DataFrame(rows, columns=["batch", "block", "part_id", "joined"])

    to = sums.groupBy("batch").applyInPandas(join, f"batch {dict(ids.dtypes)['batch']}, block int, part_id int, joined int")
    return found.join(to, ["batch", "block", "part_id"]).select("batch", "row", F.col("joined").alias("part_id"))


def token_budget(df: DataFrame, batch: str, length: str, row: str, budget: int, bucket_rows: int = 1 << 16) -> DataFrame:
    """df with micro: rows of a batch cut where the running sum of lengths, in order of the integer `row`, passes multiples of the budget.

    Sums of a batch's buckets of rows meet in one task, rows only with those of their bucket.
    """
    d = df.withColumn("__bucket", F.floor(F.col(row) / bucket_rows))
    sums = d.groupBy(batch, "__bucket").agg(F.sum(length).alias("__sum"))
    before = sums.withColumn("__before", F.sum("__sum").over(Window.partitionBy(batch).orderBy("__bucket")) - F.col("__sum")).drop("__sum")
    w = Window.partitionBy(batch, "__bucket").orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    summed = d.withColumn("__sum", F.sum(length).over(w)).join(before, [batch, "__bucket"])
    return summed.withColumn("micro", F.floor((F.col("__before") + F.col("__sum") - 1) / budget).cast("long")).select(*[F.col(f"`{c}`") for c in df.columns], "micro")


def micro_batches(df: DataFrame, batch: str, length: str, row: str, budget: int) -> DataFrame:
    """df with part_id: ceil(total / budget) balanced parts, as many in each batch as the fullest needs."""
    k = df.groupBy(batch).agg(F.ceil(F.sum(length) / budget).alias("k")).agg(F.max("k")).first()[0] or 1
    return balanced(df, batch, length, row, int(k))


def placed(df: DataFrame, parts: int) -> DataFrame:
    """Rows on the partitions that their part_id says."""
    return df.repartition(parts, "part_id")
