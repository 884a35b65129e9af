"""Approximate nearest neighbours over balanced posting lists.

Centroids are fitted on a bounded sample, with a price on each that keeps lists of like length. Every vector lies in the
list of its cheapest centroid, and a boundary vector also in those of others that are nearly as near. A query finds its
nearest centroids in an in-memory graph and searches the lists whose distance is within a ratio of the nearest one's. The
ratio is the smallest that finds the wished share of neighbours within the sample. Lists are short and grow in number
with the table, so that the share of it that a query is compared with falls.

A sample says nothing of queries that lie elsewhere than most vectors, so an exact check follows: each list keeps how near to its
centroid and how far from it its own vectors lie, and by the triangle inequality a query passes over only lists that can hold
nothing nearer than the farthest neighbour that it has found.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm._base import Workspace, mapped, rows_of, table

#: Vectors that centroids and searches are fitted on, at most (those of the smallest hash): a quarter is held out from the centroids.
SAMPLE = 1 << 17
#: Fitted vectors for each list: of fewer, a centroid lies nearer to its own fitted vectors than to any other of its list. There
#: are at most 3,072 lists (centroids and their graph are sent to the executors: 3 MB at 64 dimensions).
POINTS = 32
MOST_LISTS = SAMPLE * 3 // 4 // POINTS
#: Copies of a boundary vector at most, and how much farther than the nearest its centroids may be.
COPIES, COPY_RATIO = 4, 1.15
#: Share of the sample's nearest neighbours that a search is fitted to find there, and queries of the sample that it is fitted on.
FOUND, FITTED_QUERIES = 0.9, 512
#: What the fitted search is widened by, since most vectors are in no sample: its ratio, and its number of lists.
WIDER, MORE = 1.05, 3
#: Neighbours of a centroid in the graph, and centroids where a search begins.
DEGREE, ENTRIES = 24, 256
#: Postings, and queries, that one task compares at once; a longer list or more queries are dealt over several.
BLOCK, QUERIES = 16_384, 2_048
#: Queries whose products with a block are worked out at once.
TOGETHER = 32


@dataclass
class Lists:
    centroids: np.ndarray
    prices: np.ndarray
    neighbours: np.ndarray  # of each centroid in the graph
    ratio: float = np.inf  # of a searched list's distance to the nearest one's, at most
    most: int = MOST_LISTS  # lists that a query searches, at most

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row number, list, and whether it is the row's home: the home (cheapest) list of each vector, and those within the ratio, COPIES at most."""
        parts = []
        for start in range(0, len(x), 1024):
            d2 = squared(x[start : start + 1024], self.centroids)
            home = (d2 + self.prices).argmin(axis=1)
            m = min(COPIES, d2.shape[1])
            near = np.argpartition(d2, m - 1, axis=1)[:, :m]
            d = np.sqrt(np.take_along_axis(d2, near, 1))
            other = (d <= COPY_RATIO * d.min(axis=1, keepdims=True)) & (near != home[:, None])
            far = d.argmax(axis=1)  # makes room for the home list where that is none of the nearest
            other[np.arange(len(far)), far] &= (near == home[:, None]).any(axis=1) | (m < COPIES)
            row, at = np.nonzero(other)
            parts.append((np.concatenate([np.arange(len(home)), row]) + start, np.concatenate([home, near[row, at]]), np.concatenate([np.ones(len(home), bool), np.zeros(len(row), bool)])))
        if not parts:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))

    def search(self, q: np.ndarray, held: np.ndarray, least: int) -> np.ndarray:
        """The nearest `most` centroids within the ratio, by best-first search of the graph; and farther ones, nearest first, as
        long as the lists found are home to fewer than `least` vectors (held: vectors at home in each list)."""
        c, n = self.centroids, len(self.centroids)
        entries = np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(int))
        seen = np.zeros(n, bool)
        seen[entries] = True
        todo = list(zip(np.sqrt(((c[entries] - q) ** 2).sum(axis=1)).tolist(), entries.tolist(), strict=True))
        heapq.heapify(todo)
        worst: list[float] = []  # the `most` least distances popped so far, negated
        popped, best, stale = [], todo[0][0], 0
        while todo and stale <= 2 * DEGREE:  # beyond what can be taken a few more steps, that may lead nearer
            x, at = heapq.heappop(todo)
            best = min(best, x)
            full = len(worst) >= self.most and x > -worst[0]
            stale = stale + 1 if full or x > self.ratio * best else 0
            popped.append((x, at))
            if not full:
                heapq.heappush(worst, -x)
                if len(worst) > self.most:
                    heapq.heappop(worst)
            new = self.neighbours[at]
            new = new[~seen[new]]
            if len(new):
                seen[new] = True
                for y, e in zip(np.sqrt(((c[new] - q) ** 2).sum(axis=1)).tolist(), new.tolist(), strict=True):
                    heapq.heappush(todo, (y, e))
        found = np.array([at for x, at in sorted(popped)[: self.most] if x <= self.ratio * best], int)
        if held[found].sum() < least:
            order = np.argsort(((c - q) ** 2).sum(axis=1), kind="stable")
            found = order[: max(len(found), int(np.searchsorted(np.cumsum(held[order]), least)) + 1)]
        return found

    def beyond(self, q: np.ndarray, done: np.ndarray, reach: float, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """The lists but those done that may be home to a vector within reach: their vectors lie from near to far off the centroid."""
        d = np.sqrt(((self.centroids - q) ** 2).sum(axis=1))
        may = np.maximum(d - far, near - d) <= reach + 1e-9 * (d + far) + 1e-12 * np.sqrt((q**2).sum())  # more than roundings amount to
        may[done] = False
        return np.flatnonzero(may & (far >= near))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x**2).sum(axis=1)[:, None] - 2 * x @ y.T + (y**2).sum(axis=1))


def fit(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 11) -> Lists:
    """Balanced k-means: after each round, centroids of long lists get dearer and those of short ones cheaper, by ever less."""
    middle = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    size = float(np.abs(x - middle).max(initial=0)) or 1.0
    x = ((x - middle) / size).astype(np.float32)  # of any magnitude, and any distance from zero
    c = x[np.random.default_rng(seed).permutation(len(x))[:lists]].copy()
    lists, prices = len(c), np.zeros(len(c), np.float32)
    scale = float(squared(x[:256], c).min(axis=1).mean()) if lists else 0.0
    for i in range(rounds if lists > 1 else 0):
        at = np.concatenate([(squared(x[j : j + 1024], c) + prices).argmin(axis=1) for j in range(0, len(x), 1024)])
        n = np.bincount(at, minlength=lists)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0][:, None]
        prices += np.float32(0.04 * scale / (i + 2)) * np.clip(n * lists / len(x) - 1, -1, 1).astype(np.float32)
    m = min(DEGREE + 1, lists)
    c, prices = c.astype(float) * size + middle, prices.astype(float) * size**2
    near = [np.argpartition(squared(c[i : i + 512] - middle, c - middle), m - 1, axis=1)[:, :m] for i in range(0, lists, 512)] if lists else []
    far = np.stack([np.roll(np.arange(lists), 1), *[np.random.default_rng(seed + j).permutation(lists) for j in range(4)]], axis=1)  # a ring keeps the graph in one piece
    return Lists(c, prices, np.concatenate([np.concatenate(near), far], axis=1) if lists else far)


def fit_search(lists: Lists, x: np.ndarray, k: int, share: float = FOUND) -> tuple[float, int]:
    """The ratio and the number of lists of a search: of those that find this share of the k nearest within x, the pair that searches the fewest lists."""
    if len(lists.centroids) < 2 or len(x) < k + 2:
        return np.inf, MOST_LISTS
    q = np.linspace(0, len(x) - 1, min(FITTED_QUERIES, len(x))).astype(int)
    d = squared(x[q], x)
    d[np.arange(len(q)), q] = np.inf
    near = np.argpartition(d, k, axis=1)[:, :k]
    members, inverse = np.unique(near, return_inverse=True)
    row, at, _ = lists.assign(x[members])
    to = np.sqrt(squared(x[q], lists.centroids))
    needed = np.full((len(q), len(members)), np.inf)  # distance of the nearest list that holds a member
    for j in range(len(q)):
        np.minimum.at(needed[j], row, to[j, at])
    needed = np.take_along_axis(needed, inverse.reshape(near.shape), 1)
    to = np.sort(to, axis=1)
    rank = np.stack([np.searchsorted(t, n * (1 - 1e-12), "left") for t, n in zip(to, needed, strict=True)])
    least = np.maximum(to[:, :1], 1e-12)
    ratio, cost, out = needed / least, np.inf, (np.inf, MOST_LISTS)
    for r in np.unique(np.quantile(ratio, np.linspace(share, 1, 21), method="higher")):
        ranks = np.where(ratio <= r, rank, len(lists.centroids))
        most = int(np.quantile(ranks, share, method="higher")) + 1
        searched = np.minimum(most, (to <= r * least).sum(axis=1)).mean()
        if most <= len(lists.centroids) and searched < cost:
            out, cost = (float(r), most), searched
    return out


def valid(vectors: DataFrame) -> DataFrame:
    """Rows that take part: id and vector not null, all components finite, not all zero, of the commonest length (ties: the smaller)."""
    v = F.col("v")
    ok = vectors.where(F.col("id").isNotNull() & (F.size(v) > 0)).where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0))
    size = ok.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").first()
    return ok.where(F.size("v") == (size.n if size else 0))


def least_ids(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors (v) with the k smallest of their ids: of equal vectors no other can be among k nearest. A hot vector's
    ids are cut to k in each task before the shuffle."""
    ranked = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k)
    return ranked.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def buckets(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each list (lists in order, about BLOCK postings together) and the number of blocks of each bucket."""
    of = np.zeros(len(sizes), int)
    held, b = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > BLOCK:
            held, b = 0, b + 1
        of[i], held = b, held + n
    return of, np.maximum(1, -(-np.bincount(of, sizes, b + 1).astype(int) // BLOCK))


def nearest_in(key: list, q: np.ndarray, lists: list, at: np.ndarray, v: np.ndarray, ids: list, k: int) -> list[tuple]:
    """(key, id, distance) of the k nearest distinct ids of each query among the vectors of its lists. at: the list of each vector, in order."""
    out = []
    norms = (v**2).sum(axis=1)
    for n, (name, x, own) in enumerate(zip(key, q, lists, strict=True)):
        if n % TOGETHER == 0:  # a product of matrices, where its queries are compared with much of the block
            some = [np.concatenate([np.arange(i, j) for i, j in zip(np.searchsorted(at, o, "left").tolist(), np.searchsorted(at, o, "right").tolist(), strict=True)]) for o in lists[n : n + TOGETHER]]
            dots = q[n : n + TOGETHER] @ v.T if 4 * sum(map(len, some)) > len(some) * len(v) else None
        rows = some[n % TOGETHER]
        if not len(rows):
            continue
        rough = norms[rows] - 2 * (v[rows] @ x if dots is None else dots[n % TOGETHER][rows])
        take = k
        while True:
            kth = np.partition(rough, take - 1)[take - 1] if take < len(rows) else np.inf
            c = rows[rough <= kth + 1e-9 * (1 + abs(kth))] if np.isfinite(kth) else rows
            exact = np.sqrt(((v[c] - x) ** 2).sum(axis=1))
            best: dict = {}
            for d, i in sorted((d, i) for d, r in zip(exact.tolist(), c.tolist(), strict=True) for i in ids[r]):
                best.setdefault(i, d)
            if len(best) >= k or len(c) == len(rows):
                break
            take *= 2  # copies of a vector in several lists, or ids with several vectors
        out += [(name, i, d) for i, d in list(best.items())[:k]]
    return out


@dataclass
class Index:
    """Lists, and the table of postings: list, home, v, ids (the smallest k + 1 of an equal vector's)."""

    lists: Lists
    postings: DataFrame
    sizes: np.ndarray  # postings of each list
    held: np.ndarray  # vectors at home in each list
    near: np.ndarray  # least distance of these from the list's centroid (none: inf)
    far: np.ndarray  # and largest (none: -inf)


def indexed(x: DataFrame, ws: Workspace, k: int) -> Index:
    """The index of valid rows (id, v)."""
    spark = x.sparkSession
    nodes = ws.save(least_ids(x, k + 1), "vectors")
    n = nodes.count()
    picked = nodes.select("v", F.xxhash64("v").alias("h"))
    if n > SAMPLE:  # half as many again by the hash's value, then exactly SAMPLE
        picked = picked.where(F.pmod("h", F.lit(1 << 30)) < int(min(1.0, 1.5 * SAMPLE / n) * (1 << 30)))
    sample = picked.orderBy("h", "v").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    fitted = matrix(sample if isinstance(sample, pa.Array) else pa.array([], pa.list_(pa.float64())))
    out = len(fitted) // 4
    lists = fit(fitted[out:], max(1, min(MOST_LISTS, len(fitted[out:]) // POINTS)))
    searches = [fit_search(lists, fitted[:out], k), fit_search(lists, fitted[: 2 * out], k)]  # queries and neighbours of no list's fit, and half of them of one
    lists.ratio, lists.most = max(r for r, _ in searches) * WIDER, max(m for _, m in searches) + MORE
    sent = spark.sparkContext.broadcast(lists)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v"))
            row, at, home = sent.value.assign(x)
            off = np.sqrt(((x[row] - sent.value.centroids[at]) ** 2).sum(axis=1)) if len(row) else np.zeros(0)
            to = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(home), pa.array(off), b.column("v").take(to), b.column("ids").take(to)], names=["list", "home", "off", "v", "ids"])

    kind = x.schema["id"].dataType.simpleString()
    postings = ws.save(mapped(nodes, post, f"list int, home boolean, off double, v array<double>, ids array<{kind}>"), "postings")
    n = max(1, len(lists.centroids))
    sizes, held, near, far = np.zeros(n, int), np.zeros(n, int), np.full(n, np.inf), np.full(n, -np.inf)
    own = F.when(F.col("home"), F.col("off"))
    for r in postings.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.count(own).alias("home"), F.min(own).alias("near"), F.max(own).alias("far")).collect():  # MOST_LISTS rows
        sizes[r.list], held[r.list] = r.n, r.home
        if r.home:
            near[r.list], far[r.list] = r.near, r.far
    return Index(lists, postings, sizes, held, near, far)


def asked(index: Index, queries: DataFrame, k: int, of: np.ndarray, rest: bool) -> DataFrame:
    """key, v, bucket and lists of each query (key, v) and each bucket that holds some of the lists it searches; of the lists that it
    has not searched and that may hold something within its reach, where `rest` is asked for."""
    sent = queries.sparkSession.sparkContext.broadcast((index.lists, index.held, index.near, index.far, of))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, held, near, far, of = sent.value
        n, dim = lists.centroids.shape
        for b in batches:
            rows, bs, ls = [], [], []
            for i, v in enumerate(b.column("v").to_pylist()):
                q = np.array(v)
                found = np.sort(lists.search(q, held, k + 1)) if n and len(v) == dim else np.zeros(0, int)
                if rest and len(found):
                    found = lists.beyond(q, found, b.column("reach")[i].as_py(), near, far)
                starts = np.flatnonzero(np.diff(of[found], prepend=-1)) if len(found) else []
                for j, part in zip(starts, np.split(found, starts[1:]) if len(found) else [], strict=True):
                    rows.append(i)
                    bs.append(of[found[j]])
                    ls.append(part)
            to = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("key").take(to), b.column("v").take(to), pa.array(bs, pa.int32()), pa.array(ls, pa.list_(pa.int32()))], names=["key", "v", "bucket", "lists"])

    return mapped(queries, route, f"key {queries.schema['key'].dataType.simpleString()}, v array<double>, bucket int, lists array<int>")


def searched(index: Index, queries: DataFrame, ws: Workspace, k: int, rest: bool = False) -> DataFrame:
    """key, id and score of the queries (key, v) and the k + 1 nearest distinct ids, at most, of each cell of lists that they search:
    their nearest lists, or (of queries with a reach) what the rest may be home to."""
    spark = queries.sparkSession
    of, blocks = buckets(index.held if rest else index.sizes)
    routes = ws.save(asked(index, queries, k, of, rest), f"routes{int(rest)}")
    many = {r.bucket: r.n for r in routes.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # MOST_LISTS rows at most
    size = spark.createDataFrame([(b, int(blocks[b]), -(-n // QUERIES)) for b, n in many.items()] or [(-1, 1, 1)], "bucket int, blocks int, parts int")
    lists = spark.createDataFrame(list(enumerate(of.tolist())), "list int, bucket int")
    cell = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = (index.postings.where("home") if rest else index.postings).join(F.broadcast(lists), "list").join(F.broadcast(size), "bucket")
    rows = rows.select("bucket", F.pmod(F.xxhash64("v"), "blocks").cast("int").alias("block"), cell("parts").alias("part"), "list", "v", "ids")
    ask = routes.join(F.broadcast(size), "bucket").select("bucket", cell("blocks").alias("block"), F.pmod(F.xxhash64("key"), "parts").cast("int").alias("part"), "key", "v", "lists")

    def search(a, b):
        import pandas as pd

        out = []
        if len(a) and len(b):
            b = b.sort_values("list", kind="stable")
            out = nearest_in(a["key"].tolist(), np.stack(a["v"].to_list()), a["lists"].tolist(), b["list"].to_numpy(), np.stack(b["v"].to_list()), [list(i) for i in b["ids"]], k + 1)
        return pd.DataFrame(out, columns=["key", "id", "score"])

    kind = queries.schema["key"].dataType.simpleString()
    cells = ["bucket", "block", "part"]
    found = ask.groupBy(*cells).cogroup(rows.groupBy(*cells)).applyInPandas(search, f"key {kind}, id {kind}, score double")
    return found


def best(found: DataFrame, k: int) -> DataFrame:
    """key and found (structs of score and id, nearest first, at most k + 1 distinct ids) of what cells gave."""
    least = found.groupBy("key", "id").agg(F.min("score").alias("score"))
    return least.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "id"))), 1, k + 1).alias("found"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance): the k nearest of each query among all vectors but its own. The
    search of the index finds most of them, and the check of the lists that it passed over the rest.

    vectors and queries have the columns key and vector. Vectors that are null, zero, or hold null or non-finite components,
    or have another number of components than most, take no part, nor do null ids. Ties go to the smaller vec_id. Of repeated
    ids the nearest row counts, once. A query gets k rows, or one for each other id if those are fewer: its search goes on
    until lists with k + 1 vectors are found, and the reach of queries that still lack some (by repeated ids) has no bound. An
    empty table gives no row. Equal vectors are indexed and searched once.
    """
    ws = Workspace(vectors.sparkSession, "ann")
    rows = lambda df: rows_of(df, id=key, v=vector).select("id", F.col("v").cast("array<double>").alias("v"))
    index = indexed(valid(rows(vectors)), ws, k)
    members = ws.save(valid(rows(queries)).distinct(), "queries")
    each = ws.save(members.select("v").distinct().withColumn("key", F.monotonically_increasing_id()), "asked")
    first = ws.save(best(searched(index, each, ws, k), k), "first")
    reach = F.when(F.size("found") > k, F.col("found")[k]["score"]).otherwise(F.lit(float("inf")))
    more = searched(index, each.join(first, "key").select("key", "v", reach.alias("reach")), ws, k, rest=True)
    found = best(first.select("key", F.explode("found").alias("x")).select("key", "x.id", "x.score").unionByName(more), k)
    near = of_members(members, each, found, k)
    each_rank = near.select(F.col("id").alias("query_id"), F.posexplode("near").alias("rank", "x"))
    return each_rank.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("vec_id"), "x.score")


def of_members(members: DataFrame, each: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """id and near (structs of score and id, at most k) of members (id, v), from what was found for their vectors: never the id itself."""
    own = members.join(each, "v").select(F.col("id").alias("query"), "key").join(found, "key").select("query", F.explode("found").alias("x")).where(F.col("x.id") != F.col("query"))
    best = own.groupBy("query", F.col("x.id").alias("id")).agg(F.min("x.score").alias("score"))
    return best.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "id"))), 1, k).alias("near")).withColumnRenamed("query", "id")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100, against all of embeddings."""
    e = table(spark, sf_dir, "embeddings")
    return nearest(e, e.where("vec_id % 100 = 0"))
