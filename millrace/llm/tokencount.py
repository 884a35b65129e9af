"""Token counts: Arrow functions that return lengths only."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._base import by_bytes, mapped, one_thread, raw_texts, rows_of, table

#: Distinct fragments that a task keeps; then it starts anew.
KEPT_FRAGMENTS = 200_000
#: Bytes beyond which a fragment is split further.
LONG = 256
#: Places where the pre-tokenizer parts whatever stands around them: beside an ASCII digit, and between an ASCII letter and an ASCII
#: sign (but not after an apostrophe, which may take letters with it).
CUT = re.compile(rb"(?<=[0-9])(?=[!-~])|(?<=[!-~])(?=[0-9])|(?<=[A-Za-z])(?=[!-/:-@\[-`{-~])|(?<=[!-&(-/:-@\[-`{-~])(?=[A-Za-z])")
_models: dict[str, LengthCoder] = {}


class LengthCoder:
    """Token counts by a vocabulary (the text of its JSON file) whose pre-tokenizer drops white space.

    Such a vocabulary parts at every run of ASCII white space whatever stands around it, and no special token holds any:
    texts are cut there, long fragments also at CUT unless they may hold a special token, and each distinct fragment is
    encoded once. (A run of letters alone, of any length, is one word to the vocabulary and is encoded whole.)
    """

    def __init__(self, model: str):
        one_thread()
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(model)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.cache: dict[bytes, int] = {}

    def fragments(self, raw: bytes) -> list[bytes]:
        out = raw.split()
        if out and max(map(len, out)) > LONG:
            out = [p for f in out for p in (CUT.split(f) if len(f) > LONG and b"<|" not in f else [f])]
        return out

    def counts(self, raws: list[bytes]) -> list[int]:
        split = [self.fragments(r) for r in raws]
        if len(self.cache) > KEPT_FRAGMENTS:
            self.cache.clear()
        cache = self.cache
        new = list({f for fs in split for f in fs if f not in cache})
        for f, e in zip(new, self.tok.encode_batch([f.decode() for f in new], add_special_tokens=False), strict=True):
            cache[f] = len(e)
        return [sum(map(cache.__getitem__, fs)) for fs in split]


def coder(model: str) -> LengthCoder:
    key = hashlib.md5(model.encode()).hexdigest()
    if key not in _models:
        _models[key] = LengthCoder(model)
    return _models[key]


def count_tokens(df: DataFrame, model: str, text: str = "text", counted: str = "n_tokens") -> DataFrame:
    """df with the number of tokens of each whole text in a column `counted`, without begin, end or other added tokens.

    Batches hold about 1 MB of text each, so a very long text is alone in its batch. Null and empty texts count 0; every
    input row gives one row. An input column named as `counted` is replaced. No shuffle.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([f for f in df.schema.fields if f.name != counted] + [T.StructField(counted, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(sent.value)
        for b in by_bytes(batches, text):
            n = pa.array(c.counts(raw_texts(b.column(text))), pa.int64())
            yield pa.RecordBatch.from_arrays([n if f.name == counted else b.column(f.name) for f in schema.fields], names=schema.names)
        c.cache.clear()

    return mapped(df, run, schema)


def token_report(docs: DataFrame, model: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens) of each row of docs."""
    return count_tokens(rows_of(docs, doc_id=key, text=text), model).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    return token_report(table(spark, sf_dir, "documents"), vocabulary())
