"""Scans over arrays: a carried state, and one value for each item."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value worked out once for each row."""
    return F.transform(F.array(value), f)[0]


def scanned(items: Column, start: Column, step: Callable[[Column, Column], Column], value: Callable[[Column], Column], kind: str = "double") -> Column:
    """Array of value(state) after each item, in the order of items; null for a null array.

    A fold that appends to its result copies it at every item. Here items (beyond 64) are folded in chunks of the square root of
    their number, each with a result of its own, and only a list of chunks grows: n ** 1.5 copied values instead of n ** 2.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(a: Column, x: Column) -> Column:
        return bound(step(a["s"], x), lambda s: F.struct(s.alias("s"), F.concat(a["out"], F.array(value(s).cast(kind))).alias("out")))

    def chunk(a: Column, part: Column) -> Column:
        return bound(F.aggregate(part, F.struct(a["s"].alias("s"), none.alias("out")), one), lambda r: F.struct(r["s"].alias("s"), F.concat(a["out"], F.array(r["out"])).alias("out")))

    def whole(xs: Column) -> Column:
        n = F.size(xs)
        width = F.when(n <= 64, n).otherwise(F.ceil(F.sqrt(n.cast("double"))).cast("int"))
        parts = F.transform(F.sequence(F.lit(1), n, width), lambda i: F.slice(xs, i, width))
        return F.aggregate(parts, F.struct(start.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out")), chunk, lambda a: F.flatten(a["out"]))

    return bound(items, lambda xs: F.when(F.size(xs) > 0, whole(xs)).when(xs.isNotNull(), none))  # items are worked out once


def scanned_back(items: Column, start: Column, step: Callable[[Column, Column], Column], value: Callable[[Column], Column], kind: str = "double") -> Column:
    """scanned from the last item to the first; values in the order of items."""
    return F.reverse(scanned(F.reverse(items), start, step, value, kind))


# ---- the same from SQL text, which builds a large expression in one call ------------------------------------------------------


def quoted(x: str) -> str:
    """A string as an SQL literal."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def applied(value: Column, name: str, body: str) -> Column:
    """SQL text of a value under a name, worked out once for each row."""
    return F.call_function("transform", F.array(value), F.expr(f"{name} -> {body}"))[0]


def bound_sql(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def scanned_sql(items: str, start: str, step: str, value: str, kind: str) -> str:
    """scanned, in SQL text: step in terms of s (the state) and t (the item), value in terms of s."""
    none, lists = f"cast(array() AS array<{kind}>)", f"cast(array() AS array<array<{kind}>>)"
    one = bound_sql(step.replace("s.", "acc_.s."), "s", f"named_struct('s', s, 'out', concat(acc_.out, array(cast({value} AS {kind}))))")
    part = f"aggregate(part_, named_struct('s', all_.s, 'out', {none}), (acc_, t) -> {one})"
    chunk = bound_sql(part, "done_", "named_struct('s', done_.s, 'out', concat(all_.out, array(done_.out)))")
    width = "CASE WHEN size(items_) <= 64 THEN size(items_) ELSE cast(ceil(sqrt(size(items_))) AS int) END"
    parts = f"transform(sequence(1, size(items_), {width}), i_ -> slice(items_, i_, {width}))"
    folded = f"aggregate({parts}, named_struct('s', {start}, 'out', {lists}), (all_, part_) -> {chunk}, all_ -> flatten(all_.out))"
    return bound_sql(items, "items_", f"CASE WHEN size(items_) > 0 THEN {folded} WHEN items_ IS NOT NULL THEN {none} END")
