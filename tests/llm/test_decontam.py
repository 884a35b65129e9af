import random
import re
from collections import Counter

from helpers import DOCS, clashing, docs_of, words
from millrace.llm import decontam


def split(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(texts, items, least=0.8):
    out = set()
    for d, t in enumerate(texts):
        w = split(t)
        for i, x in enumerate(items):
            v = split(x)
            if not v or not w:
                continue
            k = min(5, len(v))
            want = Counter(tuple(v[j : j + k]) for j in range(len(v) - k + 1))
            for s in range(max(1, len(w) - len(v) + 1)):
                win = w[s : s + len(v)]
                have = Counter(tuple(win[j : j + k]) for j in range(len(win) - k + 1))
                if have and (have & want).total() >= least * (have | want).total() - 1e-12:
                    out.add((d, i))
    return out


def run(spark, texts, items):
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontam.contaminated(clashing(docs_of(spark, texts)), bench).collect()}


def test_against_all_windows(spark):
    rng = random.Random(3)
    items = [" ".join(words(rng, n, "q")) for n in (1, 3, 5, 6, 16, 30, 59)] + [None, "", "...", "dup dup dup dup dup dup dup dup"]
    texts = [None, "", "!!", " ".join(words(rng, 100))]
    for x in items:
        if x and split(x):
            v = x.split()
            for changes in (0, 1, 2):
                y = list(v)
                for _ in range(changes):
                    y[rng.randrange(len(y))] = "changed"
                texts.append(" ".join([*words(rng, 40), *y, *words(rng, 40)]))
            texts += [x, x.upper() + ".", " ".join(v[: len(v) // 2]), " ".join([*v[:3], "in", *v[3:], *words(rng, 9)])]
    texts.append(" ".join([*words(rng, 20000), *items[5].split()]))
    got, want = run(spark, texts, items), brute(texts, items)
    assert set(got) == want
    last = got[len(texts) - 1, 5]
    assert (last.word_start, last.n_words, last.similarity) == (20000, 30, 1.0)


def test_fingerprints_within_the_radius_share_a_key(spark):
    rng = random.Random(4)
    assert decontam.WIDTH * len(decontam.FLIPS) == 64
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    items, windows = [], []
    for i in range(60):
        x = rng.getrandbits(64)
        worst = [b for j, f in enumerate(decontam.FLIPS) for b in rng.sample(range(16 * j, 16 * j + 16), f + 1)]  # one flip too many in every block
        for bits in (rng.sample(range(64), decontam.RADIUS), rng.sample(worst, decontam.RADIUS), worst, []):
            y = x
            for b in bits:
                y ^= 1 << b
            windows.append((i, len(bits), signed(y)))
        items.append((i, signed(x)))
    d, b = spark.createDataFrame(windows, "n_words int, bits int, fingerprint long"), spark.createDataFrame(items, "n_words int, fingerprint long")
    near = decontam.found_near(d, b).join(d, ["n_words", "fingerprint"]).groupBy("bits").count().collect()
    assert {r.bits: r["count"] for r in near} == {0: 60, decontam.RADIUS: 120}


def test_the_index_selects(spark):
    """Of random pairs of fingerprints few share a key."""
    rng = random.Random(14)
    rand = lambda n: spark.createDataFrame([(1, rng.getrandbits(64) - (1 << 63)) for _ in range(n)], "n_words int, fingerprint long")
    assert decontam.selected(rand(300), rand(40)).count() < 0.12 * 300 * 40


def test_recall_near_the_threshold(spark):
    """Of windows whose similarity is 0.8 to 0.85, nearly all lie within the radius."""
    rng = random.Random(15)
    items, texts = [], []
    for _ in range(150):
        v = words(rng, rng.randrange(20, 64))
        m = len(v) - 4
        drop = min(m, next(x for x in range(m, -1, -1) if (m - x) / (m + x) >= 0.8))  # shingles that may differ
        y = [*v[: len(v) - drop], *[f"new{rng.randrange(10**6)}" for _ in range(drop)]]
        items.append(" ".join(v))
        texts.append(" ".join([*words(rng, 30), *y, *words(rng, 30)]))
    got, want = run(spark, texts, items), brute(texts, items)
    assert len(want) >= 150 and set(got) <= want and len(want & set(got)) >= 0.97 * len(want)


def test_multiset_similarity(spark):
    rng = random.Random(16)
    rows = [([rng.randrange(6) for _ in range(rng.randrange(1, 40))], [rng.randrange(6) for _ in range(rng.randrange(1, 40))]) for _ in range(80)] + [([1], [2]), ([5] * 300, [5] * 290)]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>").withColumn("x", decontam.weighted_similarity("a", "b"))
    for r in df.collect():
        a, b = Counter(r.a), Counter(r.b)
        assert abs(r.x - (a & b).total() / (a | b).total()) < 1e-12


def test_empty_tables_nulls_and_repeats(spark):
    item = " ".join(f"q{i}" for i in range(12))
    none = spark.createDataFrame([], DOCS)
    bench = spark.createDataFrame([(7, item), (7, item), (None, item), (8, None)], "item_id long, text string")
    assert decontam.contaminated(none, bench).count() == 0
    docs = spark.createDataFrame([(1, item), (1, "clean words only"), (None, item)], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()] == [(1, 7)]
    assert decontam.contaminated(docs, bench.where("false")).count() == 0
    assert decontam.contaminated(docs, bench.where("item_id = 8")).columns == ["doc_id", "item_id", "word_start", "n_words", "similarity"]


def test_windows_between_aligned_starts(spark):
    rng = random.Random(5)
    items, texts = [], []
    for n, edge, more in ((59, 1, 2), (100, 3, 6), (120, 3, 8)):
        v = words(rng, n, f"i{n}x")
        y = [*["changed"] * edge, *v[edge : n // 2], *["more"] * more, *v[n // 2 : n - edge], *["changed"] * edge]
        items.append(" ".join(v))
        texts += [" ".join([*words(rng, 70), *y, *words(rng, 70)]), " ".join([*words(rng, 9), *v[n // 2 :], *v[: n // 2], *words(rng, 9)])]
    items.append(" ".join(f"r{i % 7}" for i in range(40)))
    texts += [" ".join([*words(rng, 30), *[f"r{i % 7}" for i in range(200)], *words(rng, 30)]), " ".join(["x", *items[3].split(), *items[0].split(), *items[3].split()[3:]])]
    got, want = run(spark, texts, items), brute(texts, items)
    assert {(2 * i, i) for i in range(3)} <= want and set(got) == want
    for (d, i), r in got.items():  # the first of all windows' best
        w, v = split(texts[d]), split(items[i])
        grams = lambda x: Counter(tuple(x[j : j + 5]) for j in range(len(x) - 4))
        sims = [(grams(w[s : s + len(v)]) & grams(v)).total() / (grams(w[s : s + len(v)]) | grams(v)).total() for s in range(max(1, len(w) - len(v) + 1))]
        assert (r.word_start, r.similarity) == (sims.index(max(sims)), max(sims))
