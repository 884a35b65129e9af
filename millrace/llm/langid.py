"""Language identification, words first: known words by their log frequency in each language, unseen words by the longest
known character n-grams that cover them."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._base import by_bytes, mapped, raw_texts, rows_of, table

#: Labelled rows that the model is fitted on, at most, and bytes that such a text has at most.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 1 << 16
LONGEST = 5
#: Words that a task keeps with their scores; then it starts anew.
KEPT_WORDS = 100_000
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    """Rows of `word_logs` and `gram_logs`: an entry's log frequency in each language; the last row of gram_logs is that of a character never seen."""

    langs: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray
    prior: np.ndarray


def fit(rows: list[tuple[str, str]]) -> Model:
    """A model from (text, lang) rows."""
    langs = sorted({lang for _, lang in rows})
    at, L = {x: i for i, x in enumerate(langs)}, len(langs)
    words, docs = [Counter() for _ in langs], np.zeros(L)
    for text, lang in rows:
        words[at[lang]].update(WORD.findall(text.lower()))
        docs[at[lang]] += 1

    def logs(counts: list[Counter], least: int) -> tuple[list[str], np.ndarray]:
        keys = sorted(k for k, n in sum(counts, Counter()).items() if n >= least)
        size = np.array([max(1, c.total()) for c in counts], float)
        table = np.array([[c[k] for c in counts] for k in keys], float).reshape(len(keys), L)
        return keys, np.log((table + 0.5) / (size + 0.5 * (len(keys) + 1)))

    grams, tables = [], []
    for g in range(1, LONGEST + 1):
        counts = [Counter() for _ in langs]
        for c, own in zip(counts, words, strict=True):
            for w, n in own.items():
                p = f"^{w}$"
                for j in range(len(p) - g + 1):
                    c[p[j : j + g]] += n
        keys, table = logs(counts, 2)
        grams += keys
        tables.append(table)
    keys, table = logs(words, 3)
    never = np.full((1, L), math.log(1e-7))
    prior = np.log((docs + 0.5) / (docs.sum() + 0.5 * L)) if L else docs
    return Model(langs, {w: i for i, w in enumerate(keys)}, table, {w: i for i, w in enumerate(grams)}, np.concatenate([*tables, never]), prior)


class Scorer:
    """Predictions by a model, with the scores of the words met so far."""

    def __init__(self, m: Model):
        self.m = m
        self.reset()

    def reset(self) -> None:
        self.at, self.logs = dict(self.m.words), [self.m.word_logs]

    def learn(self, words: list[str]) -> None:
        """Unseen words: at each place the longest known n-gram that starts there; the mean of their logs, times two, stands for the word's."""
        grams, last, parts, sizes = self.m.grams, len(self.m.gram_logs) - 1, [], []
        for w in words:
            p, i, n = f"^{w}$", 0, 0
            while i < len(p):
                for g in range(min(LONGEST, len(p) - i), 0, -1):
                    if (x := grams.get(p[i : i + g])) is not None:
                        break
                else:
                    x = last
                parts.append(x)
                n, i = n + 1, i + max(1, g - 2)
            sizes.append(n)
            self.at[w] = len(self.at)
        starts = np.cumsum([0, *sizes[:-1]])
        self.logs.append(np.add.reduceat(self.m.gram_logs[parts], starts) / np.array(sizes)[:, None] * 2)

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """Of each text the likeliest language and its probability, the evidence tempered to at most 20 words' worth."""
        split = [WORD.findall(t.lower()) for t in texts]
        if not self.m.langs:
            return [("und", 0.0)] * len(texts)
        if len(self.at) > len(self.m.words) + KEPT_WORDS:
            self.reset()
        if new := list({w for ws in split for w in ws if w not in self.at}):
            self.learn(new)
        logs = self.logs[0] if len(self.logs) == 1 else np.concatenate(self.logs)
        self.logs, at, out = [logs], self.at, []
        for ws in split:
            if not any(c.isalpha() for w in ws for c in w):
                out.append(("und", 0.0))
                continue
            x = (self.m.prior + logs[[at[w] for w in ws]].sum(axis=0)) / len(ws) * min(len(ws), 20)
            p = np.exp(x - x.max())
            best = int(np.argmax(p))
            out.append((self.m.langs[best], float(p[best] / p.sum())))
        return out


def train_model(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> Model:
    """Fitted on a bounded sample of the rows of docs where `train` holds and neither text nor lang is null, of those of at most
    SAMPLE_BYTES bytes: of every language an equal share of `rows` (one at least, so that more languages than `rows` have one
    each), by the smallest hash of (key, text), and what smaller ones leave goes to the larger. Without any such row it predicts
    `und`."""
    d = docs.where(train & F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.octet_length(text) <= SAMPLE_BYTES))
    picked = d.select(F.col(text).alias("t"), F.col(lang).alias("g"), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("h"))
    counts = {r.g: r.n for r in picked.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    if not counts:
        return fit([])
    quotas, left = [], rows
    for i, (n, g) in enumerate(sorted((n, g) for g, n in counts.items())):
        quota = max(1, min(n, left // (len(counts) - i)))
        left = max(0, left - quota)
        share = min(1.0, (1.5 * quota + 50) / n)  # half as many again by the hash's value (and some), then exactly the quota
        quotas.append((g, quota, int(share * (1 << 30))))
    quota_of = F.broadcast(docs.sparkSession.createDataFrame(quotas, "g string, quota int, most long"))
    near = picked.join(quota_of, "g").where(F.pmod("h", F.lit(1 << 30)) < F.col("most")).withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy("h", "t")))
    return fit([(r.t, r.g) for r in near.where(F.col("k") <= F.col("quota")).select("t", "g").toLocalIterator()])


def identify(df: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with the predicted language of each whole text, and that language's probability.

    Null texts and texts without a letter are `und` with score 0. Every input row gives one row; input columns named as
    the new ones are replaced. The model (of a bounded sample) is sent to the executors. No shuffle.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([f for f in df.schema.fields if f.name not in (pred, score)] + [T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in by_bytes(batches, text):
            out = scorer.predict([raw.decode() for raw in raw_texts(b.column(text))])
            new = {pred: pa.array([x[0] for x in out], pa.string()), score: pa.array([x[1] for x in out], pa.float64())}
            yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else b.column(f.name) for f in schema.fields], names=schema.names)

    return mapped(df, run, schema)


def held_out(key: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the key as text leaves 2 modulo 4. A null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    docs = rows_of(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text", lang="lang")
    model = train_model(docs, ~held_out())
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
