import hashlib
import re

from pyspark.sql import functions as F

from helpers import clashing, docs_of, rng
from millrace.llm import fillmiddle
from millrace.llm.fillmiddle import Rope

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
ODD = ["a", "bc", "Zz", " ", "\n", "é", "ß", "İ", "7", "_", "<P", ">", "漢", "\U0001f600", "\r", "\x00", "@", "[", "`", "{", "K"]


def by_hand(doc_id, text):
    """The row that the contract names, from lists of units."""
    text = text or ""
    units, digest = UNIT.findall(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    n, h = len(units), [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h[3] % 100 < 20 else "psm", len(p), len(m), out


def test_ropes_of_any_leaf_size_split_at_every_rank():
    r = rng(2)
    for leaf in (1, 2, 3, 7, 4096):
        text = "".join(r.choice(ODD) for _ in range(60))
        units, rope = UNIT.findall(text), Rope.of(text, leaf)
        assert str(rope) == text and rope.units == len(units) and rope.chars == len(text)
        for k in range(len(units) + 2):
            left, right = rope.split_units(k)
            assert (str(left), str(right)) == ("".join(units[:k]), "".join(units[k:]))
            assert (left.chars, right.chars) == (len(str(left)), len(str(right)))
            again = left + right
            assert str(again) == text and again.units == rope.units
        for k in range(len(text) + 2):
            left, right = rope.split_chars(k)
            assert (str(left), str(right)) == (text[:k], text[k:])


def test_whole_rows_against_lists_of_units(spark):
    r = rng(4)
    texts = [None, "", "a", " ", "word", "x<P>y", "<S>", "a<M", "<", "<P><", "P>", "<S<S", "ends in <"] + ["".join(r.choice(ODD) for _ in range(r.randrange(1, 90))) for _ in range(300)]
    docs = docs_of(spark, texts).repartition(3)
    rows = fillmiddle.transform(docs, restored="back").collect()
    assert len(rows) == len(texts) and {x.form for x in rows} == {"plain", "psm", "spm"}
    for x in rows:
        assert (x.n, x.form, x.prefix_chars, x.middle_chars, x.output) == by_hand(x.doc_id, texts[x.doc_id])
        assert x.back == (texts[x.doc_id] or "")
    again = fillmiddle.restore(fillmiddle.transform(docs).select("doc_id", "output", "form")).collect()
    assert all(x.text == (texts[x.doc_id] or "") for x in again)


def test_very_long_texts_clashing_columns_repeats_and_null_ids(spark):
    long = [("word é " * 300_000), "x" * 1_000_000, "\n" * 500_000]
    rows = [(1, long[0]), (1, long[0]), (None, long[1]), (None, long[1]), (7, long[2])]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string")).withColumns({"form": F.lit("f"), "N": F.lit(0), "output": F.lit("o"), "restored": F.lit("r")})
    got = fillmiddle.transform(docs, restored="restored").select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored", "score").collect()
    assert len(got) == 5
    for x, (k, t) in zip(sorted(got, key=lambda x: (x.doc_id is None, x.doc_id or 0)), sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)), strict=True):
        assert tuple(x)[1:6] == by_hand(k, t) and x.restored == t and x.score == "clash"
    assert fillmiddle.transform(docs.limit(0)).count() == 0


def test_op12_over_whole_documents(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = fillmiddle.op12_fill_in_middle(spark, sf).collect()
    assert len(got) == len(texts)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for x in got:
        *rest, out = by_hand(x.doc_id, texts[x.doc_id])
        assert [x.n, x.form, x.prefix_chars, x.middle_chars] == rest and x.output_sha256 == sha(out) and x.restored_sha256 == sha(texts[x.doc_id])
