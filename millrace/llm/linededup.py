"""Line dedup: long lines that many documents hold stay in one of them only.

Lines are exploded in a normal form and hashed; hashes that enough documents hold are counted; what they drop comes back as line
numbers of each text, and the text is put together from the other lines by position. Built-in functions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scan import bound
from millrace.llm._base import Workspace, few_files, rows_of, table

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Lines with more than this share of all repeated lines (fewer than a thousand) are dealt over so many tasks of a join.
HOT_SHARE, SALTS = 1000, 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """The lines of a text; null as empty."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without ASCII white space at both ends, its ASCII letters in lower case."""
    bare = F.btrim(line, F.lit(" \t\n\x0b\f\r"))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def hash_pair(key: Column) -> list[Column]:
    """128 bits of a string."""
    return [F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g")]


def repeated_lines(rows: DataFrame, ws: Workspace, least_chars: int, least_docs: int) -> DataFrame:
    """id, t, u (a text's 128 bits), pos, h, g of the long lines whose hash h at least `least_docs` texts hold; written. rows: id, text.

    A first count by h, each text's lines once, takes the many lines that are unique out; it is combined before its shuffle.
    """
    long_keys = F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: F.length(k) >= least_chars)
    hashes = rows.where(F.octet_length("text") >= least_chars).select(F.explode(F.array_distinct(F.transform(long_keys, lambda k: F.xxhash64(k)))).alias("h"))
    often = ws.save(hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_docs), "often")
    texts = rows.where(F.octet_length("text") >= least_chars).select("id", "text", F.xxhash64("text").alias("t"), F.xxhash64(F.lit(1), "text").alias("u"))  # once a text, not a line
    lines = texts.select("id", "t", "u", F.posexplode(F.transform(lines_of(F.col("text")), line_key)).alias("pos", "key"))
    lines = lines.where(F.length("key") >= least_chars).select("id", "t", "u", "pos", *hash_pair(F.col("key")))
    return ws.save(salted_join(lines, often, ["h"]).select("id", "t", "u", "pos", "h", "g"), "repeated")


def salted_join(lines: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """lines joined with few (one row a key, with n: about how many lines have it). Keys with more than 1 / HOT_SHARE of all lines
    are dealt over SALTS tasks: their rows of few are copied, their lines go by text and position."""
    total = few.agg(F.sum("n")).first()[0] or 0
    hot = [r.h for r in few.where(F.col("n") * HOT_SHARE > total).select("h").collect()]  # fewer than HOT_SHARE
    salt = F.when(F.col("h").isin(hot), F.pmod(F.xxhash64("t", "pos"), F.lit(SALTS))).otherwise(0) if hot else F.lit(0)
    copies = F.when(F.col("n") * HOT_SHARE > total, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return lines.withColumn("salt", salt.cast("int")).join(few.withColumn("salt", F.explode(copies)), [*keys, "salt"]).drop("salt", "n")


def dropped_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """id, t, u (128 bits of the text) and gone (line numbers from 0, in no order) of the texts that lose lines. A document is an id;
    null is one id, smaller than all others."""
    ws = Workspace(docs.sparkSession, "lines", docs)
    rows = rows_of(docs, id=key, text=text)
    lines = repeated_lines(rows, ws, least_chars, least_docs)
    a_document = lines.groupBy("h", "g", "id").agg(F.count(F.lit(1)).alias("n"))
    found = a_document.groupBy("h", "g").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"), F.max("id").alias("keeper")).where(F.col("docs") >= least_docs)
    found = ws.save(found.drop("docs"), "found")
    away = salted_join(lines, found, ["h", "g"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    return ws.save(away.groupBy("id", "t", "u").agg(F.collect_set("pos").alias("gone")), "gone")


def without_repeated_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n_lines: str = "n_lines", n_dropped: str = "n_dropped", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS
) -> DataFrame:
    """docs with the lines that stay in the text column, and the numbers of lines before and dropped (long).

    Lines whose key has at least `least_chars` code points and is found in at least `least_docs` documents stay only in the document
    of the largest key value. Documents are told by that value: rows that share one are one document, null is one too and the
    smallest. A null text is one empty line and comes back empty. Every row gives one row, repeated rows too; input columns named as
    the new ones are replaced; an empty table gives none. Texts of any length are whole. Only texts' hashes and line numbers are
    shuffled before the last join, whose other side Spark broadcasts if it is small.
    """
    gone = dropped_lines(docs, key, text, least_chars, least_docs)
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(columns, F.col(f"`{key}`").alias("k"), F.xxhash64(f"`{text}`").alias("x"), F.xxhash64(F.lit(1), F.col(f"`{text}`")).alias("y"))
    joined = keyed.join(gone, F.col("k").eqNullSafe(F.col("id")) & (F.col("x") == F.col("t")) & (F.col("y") == F.col("u")), "left").select("row", "gone")
    whole = F.coalesce(F.col("row")[text], F.lit(""))
    numbers = lambda s: F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), s["gone"])  # noqa: E731  hashed, in order
    kept = bound(F.struct(lines_of(whole).alias("lines"), "gone"), lambda s: F.array_join(F.transform(numbers(s), lambda i: F.get(s["lines"], i)), "\n"))
    new = {
        text: F.when(F.col("gone").isNull(), whole).otherwise(kept),
        n_lines: (F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long"),
        n_dropped: F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long"),
    }
    plain = [c for c in docs.columns if c.lower() not in (n_lines.lower(), n_dropped.lower())]
    return joined.select(*[new.get(c, F.col("row")[c]).alias(c) for c in plain], *[new[c].alias(c) for c in (n_lines, n_dropped)])


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    docs = rows_of(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return few_files(without_repeated_lines(docs), docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = r"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
 l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos, len(lines) AS n FROM d),
 k AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
 f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
 m AS (SELECT k.*, f.key IS NOT NULL AND f.keeper <> k.doc_id AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, CAST(any_value(n) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""
