"""A JSON array in one large file, read by many tasks.

Spark splits the file by bytes, at closing braces, wherever these stand. A first pass tells of each block what it does to the reading
state under both hypotheses: that it starts outside a string, or inside one. These effects are put one after another, a few numbers
a block, so that a second pass knows in each block whether it starts in a string, how deep, and in which element. Elements that lie
in one block are whole; those that reach over blocks are put together from their parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.tables import materialized

_OUTSIDE, _STRING = re.compile(r'["{}\[\],]'), re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
EFFECT = "file string, start long, inside boolean, ends_inside boolean, depth int, commas map<int,long>"
PART = "file string, element long, start long, text string, whole boolean"


class Walk:
    """The structural characters of a text that comes in pieces; inside: whether it is in a string."""

    def __init__(self, inside: bool):
        self.inside = inside

    def marks(self, piece: str) -> Iterator[tuple[int, str]]:
        """(place, character) of brackets, braces and commas outside strings."""
        at = 0
        while True:
            if self.inside:
                m = _STRING.match(piece, at)
                if not m:
                    return
                at, self.inside = m.end(), False
            m = _OUTSIDE.search(piece, at)
            if not m:
                return
            at = m.end()
            if m[0] == '"':
                self.inside = True
            else:
                yield m.start(), m[0]


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], str]]:
    """((file, start of the block), piece with its closing brace). Whatever follows the array's end is not looked at, so that a brace
    too many there does no harm."""
    for f in frames:
        for file, start, value in zip(f["file"], f["start"], f["value"], strict=True):
            yield (file, int(start)), value + "}"


def _effects(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now: dict[tuple[str, int], list] = {}
    for key, piece in _blocks(frames):
        if key not in now:
            now[key] = [[Walk(h), 0, {}] for h in (False, True)]
        for state in now[key]:
            walk, depth, commas = state
            for _, c in walk.marks(piece):
                if c == ",":
                    commas[depth] = commas.get(depth, 0) + 1
                else:
                    depth += 1 if c in "[{" else -1
            state[1] = depth
    rows = [(file, start, h, walk.inside, depth, {d: n for d, n in commas.items() if d <= 1}) for (file, start), states in now.items() for h, (walk, depth, commas) in zip((False, True), states, strict=True)]
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in EFFECT.split(", ")])


def _starts(effects: list) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """Of each block whether it starts in a string, at which depth, and how many elements end before it."""
    by: dict[str, dict[int, dict[bool, tuple]]] = {}
    for r in effects:
        by.setdefault(r.file, {}).setdefault(r.start, {})[r.inside] = (r.ends_inside, r.depth, r.commas)
    out = {}
    for file, blocks in by.items():
        inside, depth, element = False, 0, 0
        for start in sorted(blocks):
            out[file, start] = (inside, depth, element)
            ends, change, commas = blocks[start][inside]
            element += commas.get(1 - depth, 0)
            inside, depth = ends, depth + change
    return out


def elements(spark: SparkSession, path: str, text: str = "value", row: str = "row_id") -> DataFrame:
    """file, row (from 0 in each file, in order) and text of the elements of the JSON array in each file of a path.

    Files are UTF-8; elements may be any values, with braces, brackets and escaped quotes in strings. What stands before the array's
    opening bracket or after its end is left out; an empty array gives none. The driver holds a few numbers for each block of a
    file (spark.sql.files.maxPartitionBytes). Both passes run here, over the same blocks whatever executors come and go; the
    elements are written to the shared folder.
    """
    least = "spark.sql.files.minPartitionNum"  # else the blocks would depend on the number of cores at the time
    kept = spark.conf.get(least, None)
    spark.conf.set(least, "1")
    try:
        found = materialized(_parts(spark, path), "elements")
    finally:
        spark.conf.unset(least) if kept is None else spark.conf.set(least, kept)
    reaching = found.where("NOT whole").groupBy("file", "element").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "").alias("text"))
    every = found.where("whole").select("file", "element", "text").unionByName(reaching)
    return every.select("file", F.col("element").alias(row), F.regexp_replace("text", r"^\s+|\s+$", "").alias(text)).where(F.length(text) > 0)


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """The elements of each block: whole ones, and parts of those that reach over blocks."""
    pieces = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    starts = spark.sparkContext.broadcast(_starts(pieces.mapInPandas(_effects, EFFECT).collect()))

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in PART.split(", ")]
        key, held, rows, depth = None, [], [], 0

        def put(whole: bool) -> None:
            rows.append((key[0], element, key[1], "".join(held), whole))
            held.clear()

        for k, piece in _blocks(frames):
            if k != key:
                if depth > 0:
                    put(False)
                key, (inside, depth, element) = k, starts.value[k]
                walk, first, over = Walk(inside), depth > 0, depth < 0  # the brace after an array's end leads below 0
            if over:
                continue
            at = 0
            for place, c in walk.marks(piece):
                if depth == 0 and c != "[":
                    raise ValueError(f"{key[0]} is no JSON array")
                if c in "[{":
                    depth += 1
                    at = place + 1 if depth == 1 else at
                elif c == "," and depth == 1:
                    held.append(piece[at:place])
                    put(not first)
                    at, first, element = place + 1, False, element + 1
                elif c in "]}":
                    depth -= 1
                    if depth == 0:
                        held.append(piece[at:place])
                        put(not first)
                        over = True
                        break
            if not over:
                held.append(piece[at:])
            if len(rows) >= 4096:
                yield pd.DataFrame(rows, columns=columns)
                rows.clear()
        if depth > 0:
            put(False)
        yield pd.DataFrame(rows, columns=columns)

    return pieces.mapInPandas(parts, PART)


def read_array(spark: SparkSession, path: str, schema: str, row: str = "row_id") -> DataFrame:
    """The objects of the JSON arrays of a path as rows of a schema, with file and row (the element's number); what is no such
    object gives nulls."""
    return elements(spark, path, "value", row).select("file", row, F.from_json("value", schema).alias("value")).select("file", row, "value.*")
