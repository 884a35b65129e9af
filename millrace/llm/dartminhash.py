"""Near-duplicate documents by DartMinHash.

A text's elements are its word shingles, weighted by their counts. Darts fall on the plane of each element (weight by rank)
at one a unit of area, by a hash of the element alone; those that hit the element's own region up to a rank bound are the
text's. Each dart belongs to a coordinate, and of each coordinate the dart of the least rank is kept: two texts keep the
same one with the probability of their weighted Jaccard similarity. Only about k log k darts are looked at.

Bands of coordinates are joined, candidates are verified by the exact weighted similarity, and classes are the connected
components of what passed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._base import Workspace, by_bytes, give_back, mapped, raw_texts, rows_of, table
from millrace.llm._graph import components

WORDS, SIMILARITY = 5, 0.8
#: A pair at the threshold shares no band with a probability of (1 - 0.8**ROWS)**BANDS = 8e-6.
BANDS, ROWS = 50, 7
#: Elements, and members, of one block of a group whose members are compared with each other, on average.
BLOCK_ELEMENTS, BLOCK_MEMBERS = 1 << 19, 1 << 10

U = np.uint64
ODD = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers over 0 and up to 1."""
    return ((x >> U(11)).astype(np.float64) + 1) * 2.0**-53


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
WIDE_SPACE = re.compile("[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Powers of an odd base and of its inverse, for hashes of substrings from running sums.
BASE = 0x100000001B3


def powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.ones(n, U)
        filled = 1
        while filled < n:
            step = min(filled, n - filled)
            out[filled : filled + step] = out[:step] * U(pow(base, filled, 2**64))
            filled += step
    return out


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (run without white space) of the texts in order, and the number of words of each text."""
    joined = b"\n".join(raws) + b"\n"
    b = np.frombuffer(joined, np.uint8)
    space = SPACE[b]
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, U), np.cumsum((b.astype(U) + U(1)) * powers(BASE, len(b)), dtype=U)])
        h = mix((run[ends] - run[starts]) * powers(pow(BASE, -1, 2**64), len(b))[starts] + (ends - starts).astype(U) * ODD)
    bounds = np.cumsum([len(r) + 1 for r in raws])
    return h, np.diff(np.searchsorted(starts, np.concatenate([[0], bounds])))


def shingles(raws: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the distinct shingles in order of their hash: text number, hash and count of each; and a hash of each
    text's whole word sequence (0: no word). A text of fewer words has one shingle, all of them."""
    raws = [WIDE_SPACE.sub(" ", r.decode()).encode() if b"\xc2" in r or b"\xe2" in r or b"\xe3" in r or b"\xe1" in r else r for r in raws]
    w, n = word_hashes(raws)
    first = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
    with np.errstate(over="ignore"):
        place = np.arange(len(w), dtype=U) - np.repeat(first, n).astype(U)
        whole = np.concatenate([np.zeros(1, U), np.cumsum(mix(w + place * ODD), dtype=U)])
        text_hash = np.where(n > 0, mix(whole[first + n] - whole[first] + n.astype(U)), U(0))
        of, h = np.repeat(np.arange(len(raws)), np.maximum(n - words + 1, np.minimum(n, 1))), None
        k = np.maximum(n - words + 1, np.minimum(n, 1))
        at = np.repeat(first - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
        h, last = np.zeros(len(at), U), np.repeat(first + n, k)
        for j in range(words):
            here = at + j
            h = mix(h * U(31) + np.where(here < last, w[np.minimum(here, max(len(w) - 1, 0))] if len(w) else U(0), U(0)) + U(j))
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return of[at], h[at], np.diff(np.concatenate([at, [len(h)]])), text_hash


def sketch(of: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, k: int) -> np.ndarray:
    """texts x k dart hashes: the signatures of weighted sets, given as text number, element hash and weight (> 0) of each element.

    An element's weight axis is cut into slabs [0, 1), [1, 2), [2, 4), ...; the ranks of a slab's darts are the arrivals of
    a Poisson process of the slab's width. Texts with a coordinate that no dart has hit are taken again to twice the rank.
    """
    out = np.zeros((texts, k), U)
    total = np.bincount(of, weight, texts)
    todo, reach = total > 0, k * (np.log(k) + 3.0)
    while todo.any():
        own = todo[of]
        o, e, x = of[own], element[own], weight[own].astype(float)
        bound = reach / np.where(total > 0, total, 1)
        darts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        lo, width, slab = 0.0, 1.0, 0
        while len(o):
            live, seed, limit = o, mix(e + U((slab + 1) * int(ODD) % 2**64)), bound[o]
            rank, i, share = np.zeros(len(o)), 0, np.minimum((x - lo) / width, 1.0)
            while len(live):
                h = mix(seed + U((2 * i + 1) * int(ODD) % 2**64))
                rank = rank - np.log(unit(h)) / width
                inside = rank <= limit
                live, rank, h, seed, limit, share = live[inside], rank[inside], h[inside], seed[inside], limit[inside], share[inside]
                if (share < 1).any():  # of slabs that are only in part the element's
                    hit = unit(mix(h ^ ODD)) < share
                    darts.append((live[hit], rank[hit], h[hit]))
                else:
                    darts.append((live, rank, h))
                i += 1
            lo, width, slab = lo + width, max(1.0, lo + width), slab + 1
            more = x > lo
            o, e, x = o[more], e[more], x[more]
        t, r, h = (np.concatenate(c) for c in zip(*darts, strict=True))
        cell = t * k + ((h & U(0xFFFFFFFF)) * U(k) >> U(32)).astype(np.int64)
        least = np.full(texts * k, np.inf)
        np.minimum.at(least, cell, r)
        found = todo & np.isfinite(least.reshape(texts, k)).all(axis=1)
        take = (r == least[cell]) & found[t]
        out.reshape(-1)[cell[take]] = h[take]
        todo &= ~found
        reach *= 2
    return out


def bands(signatures: np.ndarray, count: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """texts x count band hashes."""
    h = np.zeros((len(signatures), count), U) + np.arange(1, count + 1, dtype=U) * ODD
    with np.errstate(over="ignore"):
        for j in range(rows):
            h = mix(h * U(31) + signatures[:, j * count : (j + 1) * count])
    return h


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, whole (a hash of the word sequence, null without words) and bands of doc_id, text, text_hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", rows=128):
            of, h, n, whole = shingles(raw_texts(b.column("text")))
            bs = bands(sketch(of, h, n, b.num_rows, BANDS * ROWS)).view(np.int64)
            some = whole != 0
            at = np.arange(b.num_rows + 1, dtype=np.int32) * BANDS
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(whole.view(np.int64), mask=~some), pa.ListArray.from_arrays(pa.array(at), pa.array(bs.reshape(-1)))], names=["doc_id", "text_hash", "whole", "bands"])

    return mapped(docs, run, T.StructType([docs.schema["doc_id"], docs.schema["text_hash"], *T._parse_datatype_string("whole long, bands array<long>").fields]))


def elements(docs: DataFrame) -> DataFrame:
    """node (the text's whole) and elements: the c-th occurrence of each shingle as a hash of its own, so that overlaps of these sets are overlaps of the weighted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text"):
            of, h, n, whole = shingles(raw_texts(b.column("text")))
            each = np.repeat(h, n)
            nth = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            with np.errstate(over="ignore"):
                each = mix(each + nth.astype(U) * ODD).view(np.int64)
            at = np.concatenate([[0], np.cumsum(np.bincount(of, n, b.num_rows).astype(np.int64))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(each))], names=["node", "elements"])

    return mapped(docs, run, "node long, elements array<long>")


def links_in_block(ids: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], side: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links between texts of a and of b sides (bits 1 and 2 of side) of different components: those that join components, at most one a text."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    n = np.array([len(s) for s in sets], np.float32)
    _, column = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(sets)), n.astype(int))
    a, b = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    common, cols = np.zeros((len(a), len(b)), np.float32), (column.max() + 1) if len(column) else 0
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    step = max(64, (8 << 20) // max(1, len(sets)) // 4)
    for c in range(0, cols, step):
        i, j = np.searchsorted(column, [c, c + step])
        x = np.zeros((len(sets), step), np.float32)
        x[row[i:j], column[i:j] - c] = 1
        common += x[a] @ x[b].T
    pairs = []
    for i in range(0, len(a), 128):
        part = common[i : i + 128]
        ok = (part >= least * (n[a[i : i + 128]][:, None] + n[b][None, :] - part) - 1e-4) & (part > 0) & (roots[a[i : i + 128]][:, None] != roots[b][None, :])
        pairs += [(a[i + x], b[y]) for x, y in zip(*np.nonzero(ok), strict=True)]
    parent = {int(r): int(r) for r in roots}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in pairs:
        u, v = find(int(roots[i])), find(int(roots[j]))
        if u != v:
            parent[max(u, v)] = min(u, v)
            out.append((int(ids[i]), int(ids[j])))
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id (the smallest doc_id of its class) of each distinct doc_id of docs.

    Two texts are linked if the weighted Jaccard similarity of their five-word shingles is `least` or more; classes are the
    connected components. Words are runs without white space. Null and empty texts and texts without words are classes of
    their own. Rows with a null doc_id give no row, though their texts link others. A repeated doc_id is in one class: that
    of all copies of all its texts. Keys are integers.
    """
    ws = Workspace(docs.sparkSession, "dedup", docs)
    found = ws.save(text_classes(docs, key, text, least).where("doc_id IS NOT NULL").select("doc_id", "node").distinct(), "ids")
    several = found.where("node IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last")
    if not several.isEmpty():  # a doc_id with several texts joins their classes
        joined = found.join(several.select("doc_id", "first"), "doc_id").select(F.col("node").alias("a"), F.col("first").alias("b"))
        again = components(joined, ws, "ids")
        found = ws.save(found.join(again, "node", "left").select("doc_id", F.coalesce("root", "node").alias("node")), "joined")
    names = found.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("class_id"))
    return found.join(names, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("class_id", "doc_id")).alias("class_id"))


def text_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), node and copies of each distinct doc_id (null ones too) and text: node names
    the text's class, null for texts without words; copies is the number of rows. Texts are what is linked, whatever ids they
    have; equal texts are told by 64-bit hashes of their word sequence.

    Exact copies are put together first. The members of a band's bucket are then compared with its most central member, the
    one whose bands lie in the largest buckets; a copy group of any size takes one comparison a member. Members that are not
    known to be connected with it after that are compared with all members of their group, block by block, without a row for
    each pair. Then the components are worked out.
    """
    ws = Workspace(docs.sparkSession, "dedup", docs)
    d = rows_of(docs, doc_id=key, text=text).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text_hash", F.xxhash64("text"))
    sigs = ws.save(signed(d), "sigs")
    first = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "text_hash")  # the row whose text stands for its copies
    reps = ws.save(sigs.where("whole IS NOT NULL").groupBy("whole").agg(F.min(first).alias("row"), F.min_by("bands", first).alias("bands")).select("whole", "row.*", "bands"), "reps")
    rows = reps.select(F.col("whole").alias("doc"), F.explode("bands").alias("band"))
    sizes = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = ws.save(rows.join(sizes, "band"), "shared")
    centre = shared.groupBy("doc").agg(F.sum("n").alias("centrality"))
    leaders = shared.join(centre, "doc").groupBy("band").agg(F.max_by("doc", F.struct("centrality", "doc")).alias("leader"))
    groups = ws.save(shared.join(leaders, "band").where("doc <> leader").select("leader", "doc").distinct(), "groups")
    ws.drop("shared")
    nodes = groups.select(F.col("leader").alias("whole")).union(groups.select("doc")).distinct()
    needed = ws.save(reps.select("whole", "doc_id", "text_hash").join(nodes, "whole", "left_semi").select("doc_id", "text_hash").distinct(), "needed")
    ws.drop("reps")
    if needed.count() <= 1_000_000:  # 16 MB of ids and hashes
        needed = F.broadcast(needed)
    known = d.withColumn("doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1))).join(needed, ["doc_id", "text_hash"], "left_semi").select("text")
    sets = ws.save(elements(known).groupBy("node").agg(F.min("elements").alias("elements")), "sets")
    one, other = sets.select(F.col("node").alias("leader"), F.col("elements").alias("x")), sets.select(F.col("node").alias("doc"), F.col("elements").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    tried = ws.save(groups.join(other, "doc").join(one, "leader").select("leader", "doc", F.size("y").alias("n"), (common / (F.size("x") + F.size("y") - common) >= least - 1e-12).alias("linked")), "tried")
    ws.drop("groups")
    edges = tried.where("linked").select(F.col("leader").alias("a"), F.col("doc").alias("b"))
    more = ws.save(apart_links(unresolved(tried), sets, least), "more")
    ws.drop("sets")
    roots = components(edges.union(more), ws, "all")
    found = sigs.groupBy("doc_id", "text_hash", "whole").agg(F.count(F.lit(1)).alias("copies")).join(roots.withColumnRenamed("node", "whole"), "whole", "left")
    return ws.save(found.select("doc_id", "text_hash", F.coalesce("root", "whole").alias("node"), "copies"), "found")


def unresolved(tried: DataFrame) -> DataFrame:
    """Of groups with two members or more besides the leader, some of them not known to be connected with it: all members
    (leader, doc, root, apart, blocks). What is known: a text's least linked leader, and that one's own."""
    up = tried.where("linked").groupBy("doc").agg(F.min("leader").alias("up"))
    top = up.select("doc", F.least("doc", "up").alias("top"))
    known = top.join(top.select(F.col("doc").alias("top"), F.col("top").alias("next")), "top", "left").select("doc", F.coalesce("next", "top").alias("root"))
    m = tried.join(known, "doc", "left").join(known.select(F.col("doc").alias("leader"), F.col("root").alias("its")), "leader", "left")
    m = m.select("leader", "doc", "n", F.coalesce("root", "doc").alias("root"), (F.coalesce("root", "doc") != F.coalesce("its", "leader")).alias("other"), "linked")
    m = m.select("leader", "doc", "n", "root", (F.col("other") & ~F.col("linked")).alias("apart"))
    open_ = m.groupBy("leader").agg(F.count(F.lit(1)).alias("members"), F.count_if("apart").alias("apart_n"), F.sum("n").alias("size")).where("members > 1 AND apart_n > 0")
    return m.join(open_.select("leader", "size", "members"), "leader").select("leader", "doc", "root", "apart", F.greatest(F.ceil(F.col("size") / BLOCK_ELEMENTS), F.ceil(F.col("members") / BLOCK_MEMBERS)).alias("blocks"))


def apart_links(apart: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that join components: each block of the members apart from their leader, against each block of the group's members."""
    m = apart.withColumn("block", F.pmod(F.xxhash64("doc"), "blocks"))
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), F.lit(2).alias("side")))
    own = F.when(F.col("apart"), F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"), F.lit(1).alias("side"))))
    cells = m.select("leader", "doc", "root", F.explode(F.concat(every, F.coalesce(own, F.array().cast("array<struct<i:bigint,j:bigint,side:int>>")))).alias("c"))
    cells = cells.groupBy("leader", "doc", "root", "c.i", "c.j").agg(F.bit_or("c.side").alias("side"))
    put = cells.join(sets.withColumnRenamed("node", "doc"), "doc")

    def run(pdf):
        import pandas as pd

        found = links_in_block(pdf["doc"].to_numpy(), pdf["root"].to_numpy(), list(pdf["elements"]), pdf["side"].to_numpy(), least)
        give_back()
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return put.groupBy("leader", "i", "j").applyInPandas(run, "a long, b long")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
