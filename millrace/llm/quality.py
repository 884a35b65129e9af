"""Quality scores by a byte-level convolutional network in numpy.

Bytes are embedded; learned filters run over windows of them; of each of the overlapping chunks that cover the document,
each filter's largest response is kept; the chunks' mean goes into one logistic unit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._base import by_bytes, mapped, raw_texts, rows_of, table

#: Labelled documents of each label that the network learns from, at most, and bytes that such a text has at most.
SAMPLE_EACH, SAMPLE_BYTES = 600, 1 << 15
EMBED, WIDTH, STRIDE, FILTERS = 4, 12, 4, 24
#: Windows of half a chunk; neighbouring chunks share a half.
HALF = 48
EPOCHS, BATCH, RATE = 12, 16, 0.01


@dataclass
class Network:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray  # one number

    @staticmethod
    def new(seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        return Network(rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, FILTERS).astype(np.float32), np.zeros(1, np.float32))

    def windows(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The bytes, with zeros up to a whole window, and the embedded windows."""
        short = max(0, WIDTH - len(raw)) or -(len(raw) - WIDTH) % STRIDE
        b = np.frombuffer(raw + bytes(short), np.uint8)
        x = self.embed[b].reshape(-1)
        n = (len(b) - WIDTH) // STRIDE + 1
        return b, np.lib.stride_tricks.as_strided(x, (n, WIDTH * EMBED), (STRIDE * EMBED * 4, 4))

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """chunks x FILTERS: each chunk's largest responses, and the windows where they are."""
        z = x @ self.filters
        n = -(-len(z) // HALF)
        if n * HALF > len(z):
            z = np.concatenate([z, np.full((n * HALF - len(z), FILTERS), -np.inf, np.float32)])
        z = z.reshape(n, HALF, FILTERS)
        at = z.argmax(axis=1)
        top = np.take_along_axis(z, at[:, None], 1)[:, 0]
        at = at + np.arange(n)[:, None] * HALF
        if n > 1:
            later = top[1:] > top[:-1]
            top, at = np.where(later, top[1:], top[:-1]), np.where(later, at[1:], at[:-1])
        return np.maximum(top + self.bias, 0), at

    def score(self, raw: bytes) -> float:
        z = self.windows(raw)[1] @ self.filters
        n = len(z) // HALF
        halves = z[: n * HALF].reshape(n, HALF, FILTERS).max(axis=1)
        if n * HALF < len(z):
            halves = np.concatenate([halves, z[n * HALF :].max(axis=0)[None]])
        top = np.maximum(halves[1:], halves[:-1]) if len(halves) > 1 else halves
        v = float(np.maximum(top + self.bias, 0).mean(axis=0) @ self.out + self.out_bias[0])
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, v)))))


NAMES = ["embed", "filters", "bias", "out", "out_bias"]


def gradients(net: Network, rows: list[tuple[bytes, int]], weight: dict[int, float]) -> dict[str, np.ndarray]:
    """Of the rows' weighted log loss, over BATCH, in each part of the network."""
    grad = {k: np.zeros_like(getattr(net, k)) for k in NAMES}
    for raw, y in rows:
        b, x = net.windows(raw)
        top, at = net.pooled(x)
        mean = top.mean(axis=0)
        v = float(mean @ net.out + net.out_bias[0])
        d = np.float32(weight[y] * (1 / (1 + np.exp(-v)) - y) / BATCH)
        grad["out"] += d * mean
        grad["out_bias"] += d
        g = (top > 0) * (d * net.out / len(top))
        grad["bias"] += g.sum(axis=0)
        seen, inverse = np.unique(at, return_inverse=True)
        to = np.zeros((len(seen), FILTERS), np.float32)
        np.add.at(to, (inverse.reshape(at.shape), np.arange(FILTERS)[None, :]), g)
        grad["filters"] += x[seen].T @ to
        np.add.at(grad["embed"], b[seen[:, None] * STRIDE + np.arange(WIDTH)], (to @ net.filters.T).reshape(len(seen), WIDTH, EMBED))
    return grad


def fit(rows: list[tuple[bytes, int]], positive: float = 0.5, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """A network from (text, label) rows, both labels weighing the same; positive: the share of label 1, put into the bias in the end.

    With one label only, or no row, the network's bias alone answers.
    """
    net, rng = Network.new(seed), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(getattr(net, k)) for k in NAMES} for _ in range(2))
    labels = np.array([y for _, y in rows])
    weight = {y: len(rows) / (2 * max(1, int((labels == y).sum()))) for y in (0, 1)}
    step = 0
    for _ in range(epochs if len(set(labels.tolist())) == 2 else 0):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            grad = gradients(net, [rows[i] for i in order[start : start + BATCH]], weight)
            step += 1
            for k in NAMES:
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                update = RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, (getattr(net, k) - update).astype(np.float32))
    p = min(0.999, max(0.001, positive))
    net.out_bias = net.out_bias + np.float32(np.log(p / (1 - p)))
    return net


def train_network(docs: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id", text: str = "text", label: str = "quality", each: int = SAMPLE_EACH) -> Network:
    """Fitted on at most `each` texts of each label (0, 1): of all labelled documents where `train` holds whose text is neither null
    nor over SAMPLE_BYTES, those of the smallest hash of key and text.

    Labels that are null or contradict each other for a key are left out; labels of documents that are missing or too long take no
    room in the sample. The share of label 1 is that of all usable labelled texts.
    """
    marked = labels.where(train & F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z").select(key, "y")
    usable = docs.where(F.col(text).isNotNull() & (F.octet_length(text) <= SAMPLE_BYTES)).select(F.col(key).alias("k"), F.xxhash64(key, text).alias("h"))
    of_label = usable.join(marked, F.col("k") == F.col(key)).select("y", "k", "h")  # ids and hashes only
    counts = {r.y: r.n for r in of_label.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows: list[tuple[bytes, int]] = []
    for y in sorted(counts):
        chosen = F.broadcast(of_label.where(F.col("y") == y).select("k", "h").distinct().orderBy("h", "k").limit(each))
        texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(chosen, "k").where(F.xxhash64("k", "t") == F.col("h"))
        rows += [(r.t.encode(), y) for r in texts.select("h", "t").distinct().orderBy("h", "t").limit(each).toLocalIterator()]
    total = sum(counts.values())
    return fit(rows, counts.get(1, 0) / total if total else 0.5)


def classify(df: DataFrame, network: Network, text: str = "text", score: str = "score") -> DataFrame:
    """df with the probability of label 1 of each whole text. Null texts count as empty ones, which get the score of zero
    bytes; every row gives one row, and an input column named as the score is replaced. No shuffle."""
    sent = df.sparkSession.sparkContext.broadcast(network)
    schema = T.StructType([f for f in df.schema.fields if f.name != score] + [T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for b in by_bytes(batches, text):
            s = pa.array([net.score(r) for r in raw_texts(b.column(text))], pa.float64())
            yield pa.RecordBatch.from_arrays([s if f.name == score else b.column(f.name) for f in schema.fields], names=schema.names)

    return mapped(df, run, schema)


def held_out(key: str = "doc_id") -> Column:
    """Rows that no label is learned from: crc32 of the key as text leaves 1 modulo 3. A null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    docs = rows_of(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    labels = rows_of(table(spark, sf_dir, "labels"), doc_id="doc_id", quality="quality")
    net = train_network(docs, labels, ~held_out())
    scored = classify(docs.select("doc_id", "text", held_out().alias("held_out")), net)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
