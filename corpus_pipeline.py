"""The corpus pipeline: from the documents table to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on all of docs and returns a DataFrame; all but the last return the columns of
docs. run() writes each stage's rows as Parquet in the cluster's shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, dartminhash, decontam, langid, secrets
from millrace.llm._base import Workspace, few_files, fresh, table

#: A document whose likeliest language is less likely than this has none.
LEAST_LANGUAGE_SCORE = 0.5


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs but those whose doc_id (null ones too) and text hash are in dropped (doc_id, text_hash), or whose text hash is, where
    dropped has that column alone. They are broadcast if they have been counted to be few."""
    if dropped.count() <= 1_000_000:  # 16 MB
        dropped = F.broadcast(dropped)
    text_hash = fresh(docs, "text_hash")[0]
    keyed = docs.withColumn(text_hash, F.xxhash64("text"))
    same = keyed[text_hash] == dropped["text_hash"]
    if "doc_id" in dropped.columns:
        same &= keyed["doc_id"].cast("long").eqNullSafe(dropped["doc_id"])
    return few_files(keyed.join(dropped, same, "left_anti").drop(text_hash), docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an identified language. Null and empty texts, texts without a letter and texts of no likely language go; a
    text of any length is read whole. Rows with a null or repeated doc_id are judged like all others."""
    model = langid.train_model(docs, ~langid.held_out())
    pred, score = fresh(docs, "language", "likely")
    found = few_files(langid.identify(docs, model, pred=pred, score=score), docs)
    return found.where((F.col(pred) != "und") & (F.col(score) >= LEAST_LANGUAGE_SCORE)).drop(pred, score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicate texts one row: that of the smallest doc_id (null after all others; of one id's texts the
    smallest hash; of equal ids and texts the row that is first as JSON). Rows without a word (null and empty texts too) are in no
    class and stay. Texts of any length are compared whole."""
    found = dartminhash.text_classes(docs).where("node IS NOT NULL")
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    first = found.groupBy("node").agg(F.min(row).alias("first"))
    marked = Workspace(spark, "stage", docs).save(found.join(first, "node").select("doc_id", "text_hash", "copies", (row != F.col("first")).alias("gone")), "marked")
    kept = without(docs, marked.where("gone").select("doc_id", "text_hash"))
    again = marked.where("copies > 1 AND NOT gone").select("doc_id", "text_hash")
    if again.isEmpty():
        return kept
    rows = kept.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("k"), F.xxhash64("text").alias("h"))
    same = rows["k"].eqNullSafe(again["doc_id"]) & (rows["h"] == again["text_hash"])
    once = rows.join(again, same, "left_semi").groupBy("k", "h").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return rows.join(again, same, "left_anti").select("row.*").unionByName(once.select("row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark in any window of the whole text. A document goes by its text, whatever its
    doc_id: rows with a null or repeated doc_id are judged each by their own. Null and empty texts stay."""
    texts = docs.select(F.xxhash64("text").alias("text_hash"), F.col("text").alias("text"))
    found = decontam.contaminated(texts, table(spark, sf_dir, "benchmark"), key="text_hash").select(F.col("doc_id").alias("text_hash")).distinct()
    return without(docs, Workspace(spark, "stage", docs).save(found, "contaminated"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret, and n_chars (if there) of the new text where any was found. Null and
    empty texts, null and repeated doc_ids stay as they are; texts of any length are scanned whole."""
    spans = fresh(docs, "spans")[0]
    found = secrets.scan(docs, spans=spans)
    new = {"text": secrets.redacted("text", spans)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size(spans) > 0, F.length(new["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return few_files(found, docs).select(*[(new[c].alias(c) if c in new else F.col(f"`{c}`")) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text, decoded again: doc_id (null and repeated ones too), n_tokens and the digests of both. Null and
    empty texts have no token."""
    return few_files(bpe.digests(docs, bpe.vocabulary()), docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("redact", redact), ("encode", encode)]
#: The stages' decisions are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return docs
