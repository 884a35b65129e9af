"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A pair of neighbouring bytes that no vocabulary token holds can never be merged over, so the text may be cut there. What
lies between cuts is encoded alone, once for each distinct fragment, and the ids are concatenated.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._base import by_bytes, give_back, mapped, one_thread, raw_texts, rows_of, table

#: Distinct fragments that a task keeps; then it starts anew.
KEPT_FRAGMENTS = 120_000
_models: dict[str, FragmentCoder] = {}


def byte_of_char() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class FragmentCoder:
    """Encoder and decoder of one vocabulary (the text of its JSON file)."""

    def __init__(self, model: str):
        one_thread()
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(model)
        spec, to_byte = json.loads(model), byte_of_char()
        self.special = [x["content"].encode() for x in spec["added_tokens"]]
        vocab = {i: bytes(to_byte[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        vocab |= {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
        self.inside = np.zeros(65536, bool)
        for t in vocab.values():
            b = np.frombuffer(t, np.uint8).astype(np.int32)
            self.inside[b[:-1] << 8 | b[1:]] = True
        words = [vocab.get(i, b"") for i in range(max(vocab) + 1)]
        self.length = np.array([len(w) for w in words], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.flat = np.frombuffer(b"".join(words), np.uint8)
        self.cache: dict[bytes, bytes] = {}

    def cuts(self, raw: bytes) -> list[int]:
        """Places where both the merges and the pre-tokenizer's pattern part.

        The pattern looks past white space and at apostrophes, so no cut follows white space (only ASCII and two-byte
        characters, among which none from U+00C0 on is white space, may stand before one) and none precedes an
        apostrophe. No cut falls inside a character or the name of a special token.
        """
        b = np.frombuffer(raw, np.uint8)
        if b.size < 2:
            return []
        left, right = b[:-1], b[1:]
        before = np.concatenate([b[:1], b[:-2]]) if b.size > 2 else b[:1]
        ok = ~self.inside[left.astype(np.int32) << 8 | right]
        ok &= ((left > 0x20) & (left < 0x7F)) | ((left >= 0x80) & (left < 0xC0) & (before >= 0xC3) & (before <= 0xDF))
        ok &= ((right & 0xC0) != 0x80) & (right != 0x27)
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                ok[at : at + len(s) - 1] = False
                at = raw.find(s, at + 1)
        return (np.flatnonzero(ok) + 1).tolist()

    def fragments(self, raw: bytes) -> list[bytes]:
        at = [0, *self.cuts(raw), len(raw)]
        return [raw[i:j] for i, j in zip(at, at[1:], strict=False)] if raw else []

    def encode(self, raws: list[bytes]) -> list[np.ndarray]:
        split = [self.fragments(r) for r in raws]
        if len(self.cache) > KEPT_FRAGMENTS:
            self.cache.clear()
        cache = self.cache
        new = list({f for fs in split for f in fs if f not in cache})
        for f, e in zip(new, self.tok.encode_batch([f.decode() for f in new], add_special_tokens=False), strict=True):
            cache[f] = np.array(e.ids, np.int32).tobytes()
        return [np.frombuffer(b"".join([cache[f] for f in fs]), np.int32) for fs in split]

    def decode(self, ids: np.ndarray) -> str:
        """Bytes of the tokens one after another, as UTF-8 with U+FFFD for what is none."""
        n = self.length[ids]
        end = np.cumsum(n)
        at = np.repeat(self.first[ids] - (end - n), n) + np.arange(end[-1] if end.size else 0)
        return self.flat[at].tobytes().decode("utf-8", "replace")


def coder(model: str) -> FragmentCoder:
    """This worker's coder of a vocabulary."""
    key = hashlib.md5(model.encode()).hexdigest()
    if key not in _models:
        _models[key] = FragmentCoder(model)
    return _models[key]


def encode(df: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """df (or its columns in `keep`) with the token ids (array of int) of each whole text in a column `ids`.

    With `decoded`, a column of that name has the text of those ids again. model: the text of a byte-level vocabulary's JSON
    file (a few MB: sent to the executors). Null and empty texts get an empty array; texts of any length are encoded whole;
    every input row gives one row, repeated rows and null keys too. Input columns named as the new ones are replaced. No
    shuffle.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    new = [T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    schema = T.StructType([f for f in df.schema.fields if f.name not in (ids, decoded) and (keep is None or f.name in keep)] + new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(sent.value)
        for b in by_bytes(batches, text):
            arrays = c.encode(raw_texts(b.column(text)))
            flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
            at = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
            made = {ids: pa.ListArray.from_arrays(pa.array(at), pa.array(flat, pa.int32()))}
            if decoded:
                made[decoded] = pa.array([c.decode(a) for a in arrays], pa.string())
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else b.column(f.name) for f in schema.fields], names=schema.names)
        c.cache.clear()
        give_back()

    return mapped(df, run, schema)


def decode(df: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of each array of token ids in a column `text` (a null array: empty). Special tokens are kept. No shuffle."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([f for f in df.schema.fields if f.name != text] + [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(sent.value)
        for batch in batches:
            for b in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                col = b.column(ids)
                at = np.concatenate([[0], np.cumsum(pc.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False))])
                flat = col.flatten().to_numpy(zero_copy_only=False)
                out = pa.array([c.decode(flat[i:j]) for i, j in zip(at, at[1:], strict=False)], pa.string())
                yield pa.RecordBatch.from_arrays([out if f.name == text else b.column(f.name) for f in schema.fields], names=schema.names)

    return mapped(df, run, schema)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def digests(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs."""
    return encode(rows_of(docs, doc_id=key, text=text), model, decoded="decoded", keep=["doc_id"]).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded again."""
    return digests(table(spark, sf_dir, "documents"), vocabulary())
