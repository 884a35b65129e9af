"""URL rules judged by Bloom filter cascades.

A cascade answers membership exactly for every key of a known universe: level 1 holds the listed keys, level 2 the other
keys that pass level 1, level 3 the listed keys that pass level 2, and so on until nothing passes wrongly. A key's last
level passed in a row says whether it is listed, so judging a url takes neither a join nor the list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._base import Workspace, rows_of, table

#: Listed keys of one cascade at most; a longer list is dealt over several cascades by a hash of the key.
SHARD_KEYS = 4_000_000
#: Bytes of filters that one pass over the urls sends to the executors at most; more cascades take more passes.
PASS_BYTES = 256 << 20
#: (action, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), so that levels and functions differ."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class Bloom:
    bits: np.ndarray  # bool packed in uint8
    m: int
    k: int
    level: int

    @staticmethod
    def of(h1: np.ndarray, h2: np.ndarray, p: float, level: int) -> Bloom:
        m = max(64, math.ceil(len(h1) * -math.log(p) / math.log(2) ** 2))
        out = Bloom(np.zeros((m + 7) // 8, np.uint8), m, max(1, round(-math.log2(p))), level)
        for at in out.places(h1, h2):
            np.bitwise_or.at(out.bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        return out

    def places(self, h1: np.ndarray, h2: np.ndarray) -> Iterator[np.ndarray]:
        salt = np.uint64(self.level * 0x9E3779B97F4A7C15 % 2**64)
        a, b = mixed(h1 + salt), mixed(h2 + salt) | np.uint64(1)
        for i in range(self.k):
            yield (a + np.uint64(i) * b) % np.uint64(self.m)

    def __call__(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h1), bool)
        for at in self.places(h1, h2):
            ok &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return ok


@dataclass
class Cascade:
    """Levels 1, 2, ... of one shard of a list."""

    levels: list[Bloom]

    @staticmethod
    def first(h1: np.ndarray, h2: np.ndarray, universe: int) -> Cascade:
        """Level 1, of a rate that lets through about 0.7 other keys of the universe for each listed one."""
        return Cascade([Bloom.of(h1, h2, min(0.5, max(2.0**-40, len(h1) / (math.sqrt(2) * max(1, universe)))), 1)] if len(h1) else [])

    def finish(self, listed: tuple[np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray]) -> None:
        """others: the keys of the universe that are not listed and pass level 1."""
        here, there = others, listed
        while len(here[0]):
            f = Bloom.of(*here, 0.5, len(self.levels) + 1)
            self.levels.append(f)
            passed = f(*there)
            here, there = (there[0][passed], there[1][passed]), here

    def __call__(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        depth, going = np.zeros(len(h1), np.int32), np.ones(len(h1), bool)
        for f in self.levels:
            going &= f(h1, h2)
            depth += going
        return depth % 2 == 1

    def nbytes(self) -> int:
        return sum(f.bits.nbytes for f in self.levels)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: then up to ?, # or the end. Null or no ://: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Host suffixes of at most `labels` labels, each before the path's prefixes of the given lengths: all keys that a rule could have."""
    parts = F.split(host, r"\.", -1)
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(labels))), lambda i: F.array_join(F.slice(parts, -i, i), "."))
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in lengths]), lambda x: x.isNotNull())
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


def hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


def to_u64(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def pulled(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of one shard's keys: SHARD_KEYS of them at most, or as many false positives as expected of those."""
    t = df.select("h1", "h2").toArrow()
    return tuple(to_u64(t.column(c).combine_chunks()) if t.num_rows else np.zeros(0, np.uint64) for c in ("h1", "h2"))


def shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(h1) % np.uint64(shards)).astype(np.int64)


def build(listed: DataFrame, universe: DataFrame, shard_keys: int = SHARD_KEYS) -> list[Cascade]:
    """The cascades (one for each shard) of a list over a universe; both have one string column `key`, repeated keys and nulls ignored.

    The universe is counted, then read once for each pass; only its keys that pass level 1 are made distinct, less than one
    for each listed key.
    """
    spark = listed.sparkSession
    ws = Workspace(spark, "cascade")
    h1, h2 = hashes(F.col("key"))
    mine = ws.save(listed.where("key IS NOT NULL").distinct().withColumns({"h1": h1, "h2": h2}), "listed")
    n, rows = mine.count(), universe.count()
    shards = max(1, math.ceil(n / shard_keys))

    def part(df: DataFrame, s: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(shard_of(to_u64(b.column("h1")), shards) == s))

        return df if shards == 1 else df.mapInArrow(run, df.schema)

    cascades = [Cascade.first(*pulled(part(mine, s)), max(1, rows // shards)) for s in range(shards)]
    for i, group in enumerate(passes(cascades)):
        sent = spark.sparkContext.broadcast({s: cascades[s] for s in group})

        def passing(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                a, c = to_u64(b.column("h1")), to_u64(b.column("h2"))
                at, ok = shard_of(a, shards), np.zeros(len(a), bool)
                for s, cascade in sent.value.items():
                    ok |= (at == s) & cascade(a, c)
                yield b.filter(pa.array(ok))

        keyed = universe.where("key IS NOT NULL").select("key", h1.alias("h1"), h2.alias("h2"))
        others = ws.save(keyed.mapInArrow(passing, keyed.schema).distinct().join(mine.select("key"), "key", "left_anti"), f"others{i}")
        for s in group:
            if cascades[s].levels:
                cascades[s].finish(pulled(part(mine, s)), pulled(part(others, s)))
        ws.drop(f"others{i}")
    ws.drop("listed")
    return cascades


def passes(cascades: list[Cascade]) -> list[list[int]]:
    """Shards that may go to the executors together."""
    out, held = [[]], 0
    for s, c in enumerate(cascades):
        if held and held + 2 * c.nbytes() > PASS_BYTES:
            out.append([])
            held = 0
        out[-1].append(s)
        held += 2 * c.nbytes()
    return out


def members(df: DataFrame, lists: dict[str, list[Cascade]], keys: str = "keys") -> DataFrame:
    """df with, for each list, a column in_<list>: the longest of the row's keys (ties: the first) that is a member; null if none is."""
    from pyspark.sql import types as T

    for name, cascades in lists.items():
        for group in passes(cascades):
            sent, shards, col = df.sparkSession.sparkContext.broadcast({s: cascades[s] for s in group}), len(cascades), f"in_{name}"
            first = col not in df.columns
            h = df.withColumns({"__h1": F.transform(keys, lambda k: hashes(k)[0]), "__h2": F.transform(keys, lambda k: hashes(k)[1])})
            schema = T.StructType([*df.schema.fields, *([T.StructField(col, T.StringType())] if first else [])])

            def run(batches: Iterator[pa.RecordBatch], sent=sent, shards=shards, col=col, first=first, schema=schema) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    a, c = to_u64(b.column("__h1").flatten()), to_u64(b.column("__h2").flatten())
                    at, ok = shard_of(a, shards), np.zeros(len(a), bool)
                    for s, cascade in sent.value.items():
                        ok |= (at == s) & cascade(a, c)
                    best, i, old = [], 0, [None] * b.num_rows if first else b.column(col).to_pylist()
                    for ks, was in zip(b.column(keys).to_pylist(), old, strict=True):
                        found = [k for k, x in zip(ks or [], ok[i : i + len(ks or [])], strict=True) if x] + ([was] if was is not None else [])
                        best.append(max(found, key=len) if found else None)
                        i += len(ks or [])
                    new = pa.array(best, pa.string())
                    yield pa.RecordBatch.from_arrays([new if f.name == col else b.column(f.name) for f in schema.fields], names=schema.names)

            df = h.mapInArrow(run, schema)
            if len(group) < len(cascades):  # the next pass must not hold this one's filters
                df = df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else Workspace(df.sparkSession, "urls").save(df, col)
    return df


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages.

    rules: (allow or block, host, path); a rule fits its host and all subdomains, if the path starts with the rule's. The
    longest rule (host and path together) decides; of equally long ones a block; no rule: allow, since the key is in no
    list. Null urls have an empty host and path. The universe of the cascades is every key that any of these urls has.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    labels, lengths = max([h.count(".") + 1 for _, h, _ in rules], default=1), sorted({len(p) for *_, p in rules})
    rows = rows_of(pages, page_id=key, url=url).select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), labels, lengths) if lengths else F.array().cast("array<string>"))
    universe = rows.select(F.explode("keys").alias("key"))
    lists = {a: build(spark.createDataFrame([(h + p,) for x, h, p in rules if x == a], "key string"), universe) for a in ("block", "allow")}
    b, a = F.col("in_block"), F.col("in_allow")
    blocked = b.isNotNull() & (a.isNull() | (F.length(b) >= F.length(a)))
    return members(rows, lists).select("page_id", "host", "path", F.when(blocked, b).otherwise(a).alias("rule"), F.when(blocked, "block").otherwise("allow").alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of pages."""
    return judge(table(spark, sf_dir, "pages"), RULES)


OP2_SQL = """
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(action, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit AS (SELECT h.*, rhost || rpath AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, action DESC) AS k
        FROM h LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fit WHERE k = 1
"""
