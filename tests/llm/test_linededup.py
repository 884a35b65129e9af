import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from helpers import clashing, docs_of, rng
from millrace.llm import linededup

SPACE = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(SPACE))


def by_hand(rows):
    """(id, text) rows to (id, n_lines, n_dropped, text) rows."""
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key_of(line)].add(i)
    least = lambda i: (i is not None, i or 0)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key_of(x)) < 40 or len(held[key_of(x)]) < 5 or max(held[key_of(x)], key=least) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def ordered(rows):
    return sorted(rows, key=repr)


def got_of(df):
    return ordered((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.select("doc_id", "n_lines", "n_dropped", "text").collect())


def test_random_documents_with_null_and_repeated_ids(spark):
    r = rng(8)
    stock = [f"{c} " * 20 + "É" * (i % 3) for i, c in enumerate("abcdefghijkl")] + ["short line", "", " ", "x" * 39, "y" * 40, " " + "z" * 39, " " + "q" * 38]
    dress = lambda x: r.choice(["", " ", "\t", "\r", "\x0b "]) + r.choice([str, str.upper, str.title])(x) + r.choice(["", "\r", "  "])
    rows = []
    for _ in range(150):
        text = "\n".join(dress(r.choice(stock)) for _ in range(r.randrange(1, 9)))
        rows.append((r.choice([None, *range(40)]), r.choice([text] * 12 + [None, "", "\n"])))
    rows += rows[:30]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = got_of(linededup.without_repeated_lines(df))
    assert got == ordered(by_hand(rows)) and any(x[2] for x in got)


def test_thresholds_and_the_kept_document(spark):
    line = "L" * 40
    four = docs_of(spark, [line] * 4)
    assert all(x[2] == 0 for x in got_of(linededup.without_repeated_lines(four)))
    five = docs_of(spark, [line, f"a\n{line.lower()}\nb\n{line}", line + "\n", "\t" + line, line])
    assert got_of(linededup.without_repeated_lines(five)) == ordered([(0, 1, 1, ""), (1, 4, 2, "a\nb"), (2, 2, 1, ""), (3, 1, 1, ""), (4, 1, 0, line)])
    assert all(x[2] == 0 for x in got_of(linededup.without_repeated_lines(docs_of(spark, ["M" * 39] * 9))))
    one_document = spark.createDataFrame([(1, f"{line}\n{i}") for i in range(9)], "doc_id long, text string")
    assert all(x[2] == 0 for x in got_of(linededup.without_repeated_lines(one_document)))


def test_hot_lines_long_texts_clashing_columns_and_an_empty_table(spark):
    hot = "the same long line in every document of a hot source"
    rows = [(i, f"{hot}\nown {i}") for i in range(2500)] + [(9999, "\n".join([hot] * 20_000 + ["end"])), (3, "\n".join(f"{hot} {i % 700}" for i in range(6_000)))]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string")).withColumns({c: F.lit("clash") for c in ("id", "t", "u", "h", "g", "k", "x", "y", "pos", "gone", "row", "n", "salt", "lines")}).withColumn("N_dropped", F.lit("clash"))
    out = linededup.without_repeated_lines(df)
    assert out.where("id = 'clash' AND gone = 'clash' AND `row` = 'clash'").count() == len(rows)
    assert got_of(out) == ordered(by_hand(rows))
    assert linededup.without_repeated_lines(df.limit(0)).count() == 0


def test_op13_over_whole_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = ordered((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in by_hand(rows))
    assert ordered(map(tuple, linededup.op13_line_dedup(spark, sf).collect())) == want
