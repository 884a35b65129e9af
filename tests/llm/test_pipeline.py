"""The pipeline's stages, each against brute force on small documents."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline as cp
import test_decontam
import test_langid
import test_near_duplicates
import test_secrets
from helpers import DOCS, clashing, docs_of, words
from millrace.llm import bpe, langid

SF = "/root/testdata/sf0.001"
STAGES = dict(cp.STAGES)


def test_stages_and_registration():
    assert [n for n, _ in cp.STAGES] == ["language", "near_dedup", "decontaminate", "redact", "encode"]
    q = __spark_entry__.queries()
    assert q["pipeline"] is cp.run and all(any(k.startswith(f"op{n}_") for k in q) for n in range(1, 11))


def test_language_rejects_what_has_none(spark):
    docs = docs_of(spark, ["the house is here and there"] * 3 + [None, "", "123 456 !!!", "the tree"]).unionByName(docs_of(spark, ["la casa está aquí"] * 3, "es").withColumn("doc_id", F.col("doc_id") + 10))
    out = STAGES["language"](spark, clashing(docs), SF)
    assert {r.doc_id for r in out.collect()} == {0, 1, 2, 6, 10, 11, 12} and out.columns == clashing(docs).columns


def test_one_of_each_group_stays(spark):
    rng = random.Random(1)
    base = words(rng, 80)
    texts = [" ".join(base), " ".join(base), " ".join([*base, "more"]), " ".join(words(rng, 80)), None, None, ""]
    docs = docs_of(spark, texts)
    twice = docs.union(docs.where("doc_id IN (0, 3)")).union(spark.createDataFrame([(None, "x", "en", "s", 1)] * 2, DOCS))
    out = STAGES["near_dedup"](spark, clashing(twice), SF).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in out) == [-1, 0, 3, 4, 5, 6] and all(r.asDict().keys() == set(clashing(twice).columns) for r in out)


def test_texts_of_a_repeated_id_stay_unless_copied(spark):
    rng = random.Random(4)
    one, two, three, four = (words(rng, 80, c) for c in "abcd")
    rows = [(1, one), (1, two), (1, one), (2, [*one, "more"]), (2, three), (3, [*two, "more"]), (4, four), (4, [*four, "more"]), (None, one)]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in rows] + [(5, None, "en", "s", 1)] * 2, DOCS)
    out = [(r.doc_id, r.text) for r in STAGES["near_dedup"](spark, clashing(docs), SF).collect()]
    want = [(1, " ".join(one)), (1, " ".join(two)), (2, " ".join(three)), (5, None), (5, None)]
    assert len(out) == 6 and sorted(map(str, want)) == sorted(str(x) for x in out if x[0] != 4)
    assert {i for i, t in out if t and t.startswith(" ".join(four))} == {4}


def test_benchmark_passages_go(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    docs = docs_of(spark, ["clean words here", f"before {item} after", None, "", item.upper()])
    out = STAGES["decontaminate"](spark, clashing(docs), SF)
    assert {r.doc_id for r in out.collect()} == {0, 2, 3} and out.columns == clashing(docs).columns


def test_null_and_repeated_ids_are_judged_by_their_text(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rng = random.Random(8)
    base = words(rng, 90)
    copies = [(None, " ".join(base)), (None, " ".join([*base, "more"])), (7, " ".join([*base, "other"])), (None, "alone one two three"), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in copies], DOCS)
    got = [(r.doc_id, r.text) for r in STAGES["near_dedup"](spark, docs, SF).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(7, " ".join([*base, "other"])), (None, "alone one two three"), (None, None), (None, None)]))
    leaks = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in [(None, f"x {item} y"), (1, f"x {item} z"), (1, "clean words"), (None, "clean words"), (None, None)]], DOCS)
    got = [(r.doc_id, r.text) for r in STAGES["decontaminate"](spark, clashing(leaks), SF).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, "clean words"), (None, "clean words"), (None, None)]))


def test_equal_rows_are_one_row_of_any_order(spark):
    rows = [(1, "a b c d e f g", "en", "s", n) for n in (5, 3, 9)] + [(2, "", "en", "s", 1)] * 2
    got = [STAGES["near_dedup"](spark, spark.createDataFrame(r, DOCS), SF).collect() for r in (rows, rows[::-1])]
    assert all(sorted((r.doc_id, r.n_chars) for r in g) == [(1, 3), (2, 1), (2, 1)] for g in got)


def test_a_very_long_text_passes_all_stages(spark):
    rng = random.Random(3)
    long = " ".join(words(rng, 60000)) + " token=abcdef123"
    docs = docs_of(spark, [long, long + " more", "the small house there", None, ""])
    for name, want in (("near_dedup", {0, 2, 3, 4}), ("decontaminate", {0, 1, 2, 3, 4}), ("redact", {0, 1, 2, 3, 4}), ("encode", {0, 1, 2, 3, 4})):
        assert {r.doc_id for r in STAGES[name](spark, docs, SF).collect()} == want


def test_secrets_are_redacted(spark):
    docs = docs_of(spark, ["a token=abcdef z", "clean", None, ""])
    got = {r.doc_id: r for r in STAGES["redact"](spark, clashing(docs), SF).collect()}
    assert (got[0].text, got[0].n_chars) == ("a [SECRET] z", 12) and (got[1].text, got[1].n_chars) == ("clean", 5)
    assert got[2].text is None and got[3].text == "" and got[0].spans == "clash"


def test_ids_of_all_that_is_left(spark):
    lib = Tokenizer.from_str(bpe.vocabulary())
    got = {r.doc_id: r for r in STAGES["encode"](spark, docs_of(spark, ["a b", None]), SF).collect()}
    ids = lib.encode("a b", add_special_tokens=False).ids
    assert got[0].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and got[1].n_tokens == 0


def test_language_keeps_clashing_columns(spark):
    docs = docs_of(spark, ["the house is here and there"] * 3).withColumn("language__", F.lit("mine")).withColumn("Likely__", F.lit("own"))
    out = STAGES["language"](spark, docs, SF).collect()
    assert len(out) == 3 and all((r["language__"], r["Likely__"]) == ("mine", "own") for r in out)


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_tables(spark, name):
    assert STAGES[name](spark, spark.createDataFrame([], DOCS), SF).count() == 0


def shingles_of(t):
    w = test_decontam.split(t)
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}


def contaminated_by_hand(t, items):
    """Whether a window of a text has an item's similarity; only items that share a shingle are compared."""
    own, n = shingles_of(t), len(test_decontam.split(t))
    near = [x for x in items if test_decontam.split(x) and (shingles_of(x) & own or min(n, len(test_decontam.split(x))) < 5)]
    return bool(near and test_decontam.brute([t], near))


def test_run_over_a_whole_table_against_brute_force(spark):
    docs = {r.doc_id: (r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    train = [(t, g) for i, (t, g) in docs.items() if zlib.crc32(str(i).encode()) % 4 != 2 and t is not None and g is not None and len(t.encode()) <= langid.SAMPLE_BYTES]
    assert len(train) <= langid.SAMPLE_ROWS  # the sample is the whole table
    ids = sorted(docs)
    kept = [i for i, (lang, score) in zip(ids, test_langid.brute(train, [docs[i][0] for i in ids]), strict=True) if lang != "und" and score >= cp.LEAST_LANGUAGE_SCORE]
    first = test_near_duplicates.brute([docs[i][0] for i in kept])
    kept = [i for at, i in enumerate(kept) if first[at] == at]
    kept = [i for i in kept if not contaminated_by_hand(docs[i][0], items)]
    lib = Tokenizer.from_str(bpe.vocabulary())
    want = {}
    for i, spans in zip(kept, test_secrets.brute([docs[i][0] for i in kept]), strict=True):
        text, at, out = docs[i][0], 0, ""
        for x in filter(None, spans.split(",")):
            _, start, end = x.split(":")
            out += text[at : int(start)] + "[SECRET]" if int(start) >= at else ""
            at = max(at, int(end))
        new = out + text[at:]
        numbers = lib.encode(new, add_special_tokens=False).ids
        want[i] = (len(numbers), hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest(), hashlib.sha256(new.encode()).hexdigest())
    got = cp.run(spark, SF).collect()
    assert len(got) == len(want) and {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and 0 < len(want) < len(docs)
