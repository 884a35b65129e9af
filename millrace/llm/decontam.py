"""Benchmark decontamination with DataFrame and SQL functions only.

Words are lower-cased runs of letters and digits, shingles are five of them (an item of fewer words is one shingle). A
window has an item's number of words. Windows are laid only at starts where as many of the window's shingles are shared with
items of its size as the least similarity takes: a lossless prefilter, which says nothing of the item. Each window's 64-bit
SimHash is looked up in a multi-index of the items of its size: four blocks of 16 bits, where an item stands under every
value within 4, 4, 3 and 3 flips of its own. Of two fingerprints that differ in 17 bits or fewer some block is within its
flips, so that four keys of a window find all items within that radius. They are verified by the exact similarity of the
shingles weighted by their counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scan import scanned
from millrace.llm._base import Workspace, rows_of, table

WORDS, SIMILARITY = 5, 0.8
#: Width of a block and the flips within which each is enumerated. A window of similarity 0.8 differs from its item in 9.7 of 64
#: bits on average, and in more than 17 with a probability of 0.005; of similarity 0.85, of 0.0005.
WIDTH, FLIPS = 16, (4, 4, 3, 3)
#: All fingerprints within this distance meet: a farther one differs in more than its flips in every block.
RADIUS = sum(f + 1 for f in FLIPS) - 1
#: Bytes of the rows of a side that is broadcast, at most (they are added up first); beyond, Spark shuffles both sides.
BROADCAST_BYTES = 16 << 20


def word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def shingle_hashes(words: str, k: int) -> Column:
    """Hashes of the k-word shingles of an array column of word hashes, in order. A lambda binds the array, so that Spark works it out once."""
    at = ", ".join(f"w[i + {j}]" for j in range(k))
    each = f"w -> CASE WHEN size(w) >= {k} THEN transform(sequence(0, size(w) - {k}), i -> xxhash64({at})) ELSE cast(array() AS array<bigint>) END"
    return F.expr(f"transform(array({words}), {each})[0]")


def simhash(shingles: str) -> Column:
    """The sign of each bit's sum over an array column of shingle hashes, as 64 bits. Bits b and b + 32 are counted in one long."""
    ones = "aggregate(s, 0L, (n, h) -> n + (shiftright(h, b) & 4294967297L))"
    both = f"transform(array({ones}), n -> shiftleft(CASE WHEN 2 * (n & 4294967295L) > size(s) THEN 1L ELSE 0L END, b) | shiftleft(CASE WHEN 2 * shiftright(n, 32) > size(s) THEN 1L ELSE 0L END, b + 32))[0]"
    return F.expr(f"transform(array({shingles}), s -> aggregate(sequence(0, 31), 0L, (a, b) -> a | {both}))[0]")


def keys(fingerprint: str) -> Column:
    """An array of (block, value, flips) of a fingerprint."""
    value = lambda j: f"cast(shiftright({fingerprint}, {WIDTH * j}) & {(1 << WIDTH) - 1}L AS int)"
    return F.array(*[F.expr(f"struct({j} AS block, {value(j)} AS value, {f} AS flips)") for j, f in enumerate(FLIPS)])


def variants(keyed: DataFrame) -> DataFrame:
    """Every value within its block's flips, of rows with block, value and flips: one for each mask of as few bits."""
    masks = keyed.sparkSession.range(1 << WIDTH).select(F.col("id").cast("int").alias("mask"), F.bit_count("id").alias("bits")).where(F.col("bits") <= max(FLIPS))
    each = keyed.withColumn("bits", F.explode(F.sequence(F.lit(0), F.col("flips"))))
    return each.join(F.broadcast(masks), "bits").withColumn("value", F.expr("value ^ mask")).drop("bits", "mask")  # 2,517 masks


def occurrences(a: Column) -> Column:
    """Each item with the number of equal ones before it, as one hash: sets of these overlap as the multisets do."""
    ordered = F.array_sort(a)
    start = F.struct(F.lit(0).cast("long").alias("x"), F.lit(-1).alias("n"))
    nth = scanned(ordered, start, lambda s, x: F.struct(x.alias("x"), F.when((s["n"] >= 0) & (s["x"] == x), s["n"] + 1).otherwise(0).alias("n")), lambda s: s["n"], "int")
    return F.zip_with(ordered, nth, lambda x, n: F.xxhash64(x, n))


def weighted_similarity(a: str, b: str) -> Column:
    """Jaccard similarity of two arrays as multisets."""
    x, y = F.col(a), F.col(b)
    single = (F.size(F.array_distinct(x)) == F.size(x)) | (F.size(F.array_distinct(y)) == F.size(y))  # of one without repeats no shingle counts twice
    common = F.when(single, F.size(F.array_intersect(x, y))).otherwise(F.size(F.array_intersect(occurrences(x), occurrences(y))))
    return F.transform(F.array(common), lambda n: n / (F.size(x) + F.size(y) - n).cast("double"))[0]


def starts(least: float) -> Column:
    """Starts of windows that can have the least similarity, in order, by `n` shingles of the document, `m` of the item and
    `ps`, the ordered positions of the document's shingles that occur in items of that size.

    A window of v shingles of similarity x has x / (1 + x) * (m + v) shingles in common with its item, or more. Each start
    is laid at the first of `ps` not before it.
    """
    v = "least(m, n)"
    c = f"greatest(1, cast(ceil({least / (1 + least)!r}D * (m + {v}) - 1e-6D) AS int))"
    low = f"greatest(0, CASE WHEN i > 0 THEN ps[i - 1] + 1 ELSE 0 END, ps[i + c - 1] - {v} + 1)"
    each = f"transform(array({low}), a -> CASE WHEN a <= least(ps[i], n - {v}) THEN sequence(a, least(ps[i], n - {v})) ELSE cast(array() AS array<int>) END)[0]"
    laid = f"CASE WHEN size(ps) >= c THEN flatten(transform(sequence(0, size(ps) - c), i -> {each})) ELSE cast(array() AS array<int>) END"
    return F.expr(f"transform(array({c}), c -> {laid})[0]")


def few(df: DataFrame, width: Column | int) -> DataFrame:
    """df, to be broadcast if its rows' bytes (width: of a row, at most) have been added up to few."""
    size = df.agg(F.sum(width if isinstance(width, Column) else F.lit(width))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, word_start, n_words, similarity: for each document and each benchmark item that a window of it
    matches, the first of the most similar windows. word_start counts words from 0.

    A document of fewer words than the item is one window. Null, empty and wordless texts and items match nothing; rows with
    a null doc_id or item_id give no row; repeated doc_ids count as one document with all their texts, repeated items as
    one. Other columns are ignored.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "decontam", docs)
    d = rows_of(docs, doc_id=key, text=text).where("doc_id IS NOT NULL").select("doc_id", word_hashes(F.col("text")).alias("w"))
    b = rows_of(benchmark, item_id=item, text=item_text).where("item_id IS NOT NULL").withColumn("w", word_hashes(F.col("text"))).where("size(w) > 0")
    b = b.withColumn("k", F.least(F.size("w"), F.lit(WORDS)))
    sized = [b.where(F.col("k") == k).withColumn("s", shingle_hashes("w", k)) for k in range(1, WORDS + 1)]
    parts = sized[0]
    for x in sized[1:]:
        parts = parts.unionByName(x)
    items = ws.save(parts.select("item_id", F.size("w").alias("n_words"), "k", "s").withColumn("fingerprint", simhash("s")), "items")
    kinds = [r.k for r in items.select("k").distinct().collect()]  # WORDS values at most
    hits = None
    for k in sorted(kinds):
        own = items.where(F.col("k") == k).select("n_words", F.explode("s").alias("shingle")).distinct()
        ours = d.select("doc_id", shingle_hashes("w", k).alias("s")).select("doc_id", F.size("s").alias("n"), F.posexplode("s").alias("p", "shingle"))
        found = ours.join(few(own, 16), "shingle").select("doc_id", "n", "n_words", F.lit(k).alias("k"), "p")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return docs.select(F.col(f"`{key}`").alias("doc_id")).where("false").crossJoin(items.select("item_id")).select("doc_id", "item_id", F.lit(0).alias("word_start"), F.lit(0).alias("n_words"), F.lit(0.0).alias("similarity"))
    placed = hits.groupBy("doc_id", "n", "n_words", "k").agg(F.sort_array(F.collect_set("p")).alias("ps")).withColumn("m", F.expr("n_words - k + 1")).withColumn("starts", starts(least)).where("size(starts) > 0")
    windows = ws.save(placed.groupBy("doc_id").agg(F.collect_list(F.struct("n", "n_words", "k", "starts")).alias("windows")), "windows")
    laid = d.join(few(windows, F.expr("aggregate(windows, 16L, (a, x) -> a + 32 + 4 * size(x.starts))")), "doc_id")
    looked = None
    for k in sorted(kinds):
        own = laid.withColumn("s", shingle_hashes("w", k)).select("doc_id", "s", F.explode(F.expr(f"filter(windows, x -> x.k = {k} AND x.n = size(s))")).alias("x"))
        own = own.select("doc_id", "s", "x.n_words", F.explode("x.starts").alias("start"))
        own = own.select("doc_id", "start", "n_words", F.expr(f"slice(s, start + 1, n_words - {k - 1})").alias("shingles"))
        looked = own if looked is None else looked.unionByName(own)
    looked = ws.save(looked.withColumn("fingerprint", simhash("shingles")), "looked")
    pairs = ws.save(found_near(looked, items), "pairs")
    sized = items.select("item_id", "n_words", F.col("s").alias("item_shingles"), F.col("fingerprint").alias("item_fingerprint")).distinct()
    near = looked.join(few(pairs, 24), ["n_words", "fingerprint"]).join(few(sized, F.size("item_shingles") * 8 + 32), ["n_words", "item_fingerprint"])
    exact = near.withColumn("similarity", weighted_similarity("item_shingles", "shingles")).where(F.col("similarity") >= least)
    best = F.max_by(F.struct("start", "n_words"), F.struct("similarity", -F.col("start"))).alias("w")
    return exact.groupBy("doc_id", "item_id").agg(best, F.max("similarity").alias("similarity")).select("doc_id", "item_id", F.col("w.start").alias("word_start"), "w.n_words", "similarity")


def selected(looked: DataFrame, items: DataFrame) -> DataFrame:
    """n_words, fingerprint, item_fingerprint that share a key of the multi-index: once for each distinct fingerprint, however many
    windows have it."""
    index = variants(items.select("n_words", F.col("fingerprint").alias("item_fingerprint")).distinct().select("*", F.explode(keys("item_fingerprint")).alias("x")).select("n_words", "item_fingerprint", "x.*"))
    asked = looked.select("n_words", "fingerprint").distinct().select("*", F.explode(keys("fingerprint")).alias("x")).select("n_words", "fingerprint", "x.block", "x.value")
    index = index.hint("merge")  # its size is thousands of times what Spark takes it for: never to be broadcast
    return asked.join(index, ["n_words", "block", "value"]).select("n_words", "fingerprint", "item_fingerprint").distinct()


def found_near(looked: DataFrame, items: DataFrame) -> DataFrame:
    """The selected pairs of fingerprints that lie within the radius."""
    return selected(looked, items).where(F.bit_count(F.expr("fingerprint ^ item_fingerprint")) <= RADIUS)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents against every item of benchmark."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
