"""Small tables for the tests of this folder."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, stem="w"):
    return [f"{stem}{rng.randrange(5000)}" for _ in range(n)]


def docs_of(spark, texts, lang="en"):
    """A documents table of texts, numbered from 0, with extra columns named like those that operators add."""
    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """df with extra columns that bear names of the operators' own columns."""
    from pyspark.sql import functions as F

    for c in ("ids", "decoded", "n_tokens", "score", "spans", "w", "s", "bands", "weight", "start", "windows", "__x", "class_id", "item_id", "held_out", "key", "list", "block", "host", "path"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit("clash"))
    return df


def rng(seed=1):
    return random.Random(seed)
