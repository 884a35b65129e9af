"""Both coders against the tokenizers library."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helpers import DOCS, clashing, docs_of
from millrace.llm import bpe, tokencount

TEXTS = [
    "", None, " ", "a'sx—'s don't <|endoftext|>x  <|endoftext|>\n\n Bar", "日本語テキスト です。é'éa  b  c", "x\n\n\nY  z\t\t w", "'ll'dé—'t!!'s",
    "😀😀 é́ ñ", "\u0085a\u0085  b", "İstanbul ΣΑΣ ſ Á b", "<|startoftext|>hi<|endoftext|> <|STARTOFTEXT|>", "same", "same", "é" * 3000 + " ", "abc déf " * 20000, "x" * 50000,
]


@pytest.fixture(scope="module")
def byte_model():
    return bpe.vocabulary()


@pytest.fixture(scope="module")
def word_model():
    return tokencount.vocabulary()


def test_ids_and_text_equal_the_library(spark, byte_model):
    lib = Tokenizer.from_str(byte_model)
    got = {r.doc_id: r for r in bpe.digests(clashing(docs_of(spark, TEXTS)), byte_model).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'’—.,!?éèñüßaesdtlrvm0159<|>")), st.characters(codec="utf-8")), max_size=60))
def test_any_text(text):
    c, lib = bpe.coder(MODEL), LIB
    ids = c.encode([text.encode()])[0]
    assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids
    assert c.decode(ids) == lib.decode(ids.tolist(), skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'’—.,!?éÉñΣσaSdt<|>0159")), st.characters(codec="utf-8")), max_size=60))
def test_any_count(text):
    assert tokencount.coder(WORDS).counts([text.encode()]) == [len(WORD_LIB.encode(text, add_special_tokens=False).ids)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("'’—.,!?=éÉñΣσaSdt<|>0159\u0301\u0338")), st.characters(codec="utf-8")), max_size=60))
def test_any_count_of_long_fragments(text):
    c = tokencount.LengthCoder(WORDS)
    was, tokencount.LONG = tokencount.LONG, 4
    try:
        assert c.counts([text.encode()]) == [len(WORD_LIB.encode(text, add_special_tokens=False).ids)]
    finally:
        tokencount.LONG = was


def test_a_long_text_without_blanks_is_split():
    text = "".join(f"key{i}=value;it's,{i}<|endoftext|>" if i == 7 else f"key{i}=value;it's,{i}" for i in range(5000))
    c = tokencount.LengthCoder(WORDS)
    assert c.counts([text.encode(), text.replace("<|endoftext|>", "").encode()]) == [len(WORD_LIB.encode(t, add_special_tokens=False).ids) for t in (text, text.replace("<|endoftext|>", ""))]
    assert max(map(len, c.fragments(text.replace("<|endoftext|>", "").encode()))) < 16


MODEL, WORDS = bpe.vocabulary(), tokencount.vocabulary()
LIB, WORD_LIB = Tokenizer.from_str(MODEL), Tokenizer.from_str(WORDS)


def test_decode_of_part_of_a_character(spark, byte_model):
    ids = LIB.encode("日本", add_special_tokens=False).ids
    df = spark.createDataFrame([(ids[:1],), (None,), ([],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(df, byte_model).collect()] == [LIB.decode(ids[:1]), "", ""]


def test_counts_equal_the_library(spark, word_model):
    lib = Tokenizer.from_str(word_model)
    got = {r.doc_id: r for r in tokencount.token_report(clashing(docs_of(spark, TEXTS)), word_model, limit=10).collect()}
    for i, t in enumerate(TEXTS):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 10)


def test_empty_tables(spark, byte_model, word_model):
    none = spark.createDataFrame([], DOCS)
    assert bpe.digests(none, byte_model).count() == 0
    assert tokencount.token_report(none, word_model).count() == 0


def test_repeated_rows_and_null_keys(spark, byte_model):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b")], "doc_id long, text string")
    assert bpe.digests(df, byte_model).count() == 3
    assert tokencount.token_report(df, tokencount.vocabulary()).count() == 3
