"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._base import Workspace


def components(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """node and root (the smallest node of its component) of every node of edges (a, b); nulls and loops are no edges.

    Large-star and small-star steps in turn until nothing changes: each node's neighbours are linked to the smallest of
    them, so a hub of any degree is only ever an aggregate of its edges. Each step's edges are written to the shared folder.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            near = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            near = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        linked = near.join(least, "u")
        if large:
            out = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum((F.xxhash64("a", "b") % 1_000_003).cast("long"))).first())

    now = ws.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0")
    was, i = state(now), 0
    while was[0]:
        i += 1
        now = ws.save(star(star(now, True), False), f"{name}{i}")
        ws.drop(f"{name}{i - 1}")
        if (new := state(now)) == was:
            break
        was = new
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
