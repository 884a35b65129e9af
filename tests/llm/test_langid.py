import math
import random
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

from helpers import DOCS, clashing, docs_of
from millrace.llm import langid

ROWS = [("the house is green and the tree is tall", "en"), ("la casa es verde y el árbol es alto", "es"), ("das haus ist grün und der baum ist hoch", "de")] * 5


@pytest.fixture(scope="module")
def model():
    return langid.fit(ROWS)


def test_known_and_unseen_words(model):
    s = langid.Scorer(model)
    got = s.predict(["the tree is green", "der grünste baum hochhaus", "la casita altísima", "treehouses", "", "12 34 !!", "²"])
    assert [g[0] for g in got] == ["en", "de", "es", "en", "und", "und", "und"]
    assert all(0 <= g[1] <= 1 for g in got)


def test_backoff_takes_the_longest_known_gram(model):
    s = langid.Scorer(model)
    s.learn(["grünes"])
    row = s.logs[-1][-1]
    assert row.argmax() == model.langs.index("de")


def test_table(spark, model):
    texts = ["the house", None, "", "123", "das haus " * 50000, "the house"]
    rows = langid.identify(clashing(docs_of(spark, texts)), model).collect()
    got = {r.doc_id: r for r in rows}
    assert [got[i].lang_pred for i in range(6)] == ["en", "und", "und", "und", "de", "en"]
    assert got[1].score == 0 and got[0].score == got[5].score


def test_training_leaves_out_held_out_rows_and_nulls(spark):
    rows = [(i, "alpha beta gamma" if i % 2 else "uno dos tres", "aa" if i % 2 else "bb", "s", 1) for i in range(40)]
    docs = spark.createDataFrame([*rows, (100, None, "cc", "s", 0), (101, "text", None, "s", 4), (None, "x y", "dd", "s", 3)], DOCS)
    m = langid.train_model(docs, ~langid.held_out())
    assert m.langs == ["aa", "bb", "dd"]
    import zlib

    kept = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert len(kept) == docs.where(~langid.held_out()).where("doc_id < 100").count()


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    m = langid.train_model(docs, ~langid.held_out())
    assert m.langs == [] and langid.identify(docs, m).count() == 0
    assert langid.identify(docs_of(spark, ["hello"]), m).first().lang_pred == "und"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang")
    got = langid.op8_language_id(spark, "/root/testdata/sf0.001").join(docs, "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count() > 0


def brute(rows, texts):
    """Predictions written out once more, word by word with dictionaries."""
    langs = sorted({g for _, g in rows})
    words = {g: Counter(w for t, x in rows if x == g for w in re.findall(r"[^\W\d_]+", t.lower())) for g in langs}
    grams = {n: {g: Counter() for g in langs} for n in range(1, 6)}
    for g in langs:
        for w, c in words[g].items():
            p = f"^{w}$"
            for n in grams:
                for j in range(len(p) - n + 1):
                    grams[n][g][p[j : j + n]] += c

    def logs(counts, least):
        known = [k for k, n in sum(counts.values(), Counter()).items() if n >= least]
        return {k: [math.log((counts[g][k] + 0.5) / (max(1, counts[g].total()) + 0.5 * (len(known) + 1))) for g in langs] for k in known}

    word_logs, gram_logs = logs(words, 3), {n: logs(grams[n], 2) for n in grams}
    docs = Counter(g for _, g in rows)
    prior = [math.log((docs[g] + 0.5) / (len(rows) + 0.5 * len(langs))) for g in langs]

    def word(w):
        if w in word_logs:
            return word_logs[w]
        p, i, parts = f"^{w}$", 0, []
        while i < len(p):
            n = next((n for n in range(min(5, len(p) - i), 0, -1) if p[i : i + n] in gram_logs[n]), 0)
            parts.append(gram_logs[n][p[i : i + n]] if n else [math.log(1e-7)] * len(langs))
            i += max(1, n - 2)
        return [2 * sum(c) / len(parts) for c in zip(*parts, strict=True)]

    out = []
    for t in texts:
        ws = re.findall(r"[^\W\d_]+", (t or "").lower())
        if not any(c.isalpha() for w in ws for c in w):
            out.append(("und", 0.0))
            continue
        x = [(p + sum(word(w)[i] for w in ws)) / len(ws) * min(len(ws), 20) for i, p in enumerate(prior)]
        e = [math.exp(v - max(x)) for v in x]
        out.append((langs[x.index(max(x))], max(e) / sum(e)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "er", "mi"], "cc": ["é", "ño", "ka", "que"]}
    make = lambda g: " ".join("".join(rng.choices(parts[g], k=rng.randrange(1, 5))) for _ in range(rng.randrange(1, 30)))
    rows = [(make(g), g) for g in parts for _ in range(40)]
    texts = [make(rng.choice(list(parts))) for _ in range(80)] + [None, "", "12 _ !", "zzz ЖЖ", "KA lo, MI.", "ka " * 40000]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(clashing(docs_of(spark, texts)), langid.fit(rows)).collect()}
    for i, (lang, score) in enumerate(brute(rows, texts)):
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-9


def test_a_rare_language_is_learned(spark, monkeypatch):
    rows = [(i, "alpha beta gamma delta", "aa", "s", 1) for i in range(3000)] + [(i, "uno dos tres quatro", "bb", "s", 1) for i in range(3000, 3020)]
    m = langid.train_model(spark.createDataFrame(rows, DOCS), ~langid.held_out(), rows=40)
    assert m.langs == ["aa", "bb"]


def test_every_language_is_learned_however_many(spark):
    rows = [(4 * i + j, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}word{x}" for x in range(30)), f"l{i:03}", "s", 0) for i in range(250) for j in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.train_model(docs, F.lit(True))
    assert len(model.langs) == 250
    assert all(r.lang == r.lang_pred for r in langid.identify(docs, model).collect())
    few = langid.train_model(docs, F.lit(True), rows=100)
    assert len(few.langs) == 250
