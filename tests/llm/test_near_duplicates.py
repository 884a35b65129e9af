import random
from collections import Counter

import numpy as np
import pytest

from helpers import DOCS, clashing, docs_of, words
from millrace.llm import dartminhash as dm


def brute(texts, least=0.8):
    """Classes by all pairs of weighted similarities."""
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append(Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = (sets[i] | sets[j]).total()
            if sets[i] and sets[j] and (sets[i] & sets[j]).total() >= least * both:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def classes(df):
    return {r.doc_id: r.class_id for r in dm.near_duplicates(df).collect()}


def edited(rng, base, n):
    out = list(base)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"edit{rng.randrange(10**6)}"
    return " ".join(out)


def test_collisions_are_weighted_similarity():
    rng = np.random.default_rng(1)
    e, w = rng.integers(1, 2**62, 300).astype(np.uint64), rng.uniform(0.1, 9, 300)
    v = w.copy()
    v[:150] *= rng.uniform(0, 3, 150)
    s = dm.sketch(np.repeat([0, 1], 300), np.concatenate([e, e]), np.concatenate([w, v]), 2, 8000)
    assert abs((s[0] == s[1]).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.02


def test_word_hashes_follow_split():
    raws = ["", " a b  c ", "a", "a b c d e f", "ü　x\x1cy"]
    of, h, n, whole = dm.shingles([r.encode() for r in raws])
    assert np.bincount(of, n, 5).tolist() == [0, 1, 1, 2, 1]
    assert whole[0] == 0 and len(set(whole.tolist())) == 5


def test_against_brute_force(spark):
    rng = random.Random(5)
    bases = [words(rng, n) for n in (8, 30, 60, 120, 250)]
    texts = [edited(rng, b, k) for b in bases for k in [0, 0, 1, 1, 2, 3, 4, 6, 8, 10]]
    texts += [" ".join(words(rng, 4)), "one two", "one two", "one", "", "", None, None, " \n", "repeat me please now and " * 40, "repeat me please now and " * 41, " ".join(words(rng, 30000))]
    rng.shuffle(texts)
    want, got = brute(texts), classes(clashing(docs_of(spark, texts)))
    assert [got[i] for i in range(len(texts))] == want


def test_hub_group_and_members_apart(spark, monkeypatch):
    """Copies that are linked only through their base, and pairs of copies that are linked only to each other."""
    rng = random.Random(9)
    base = words(rng, 100)
    texts = [edited(rng, base, 2) for _ in range(60)] + [" ".join(base)]
    for _ in range(10):
        far = edited(rng, base, 5)
        texts += [far, edited(rng, far.split(), 1)]
    rng.shuffle(texts)
    monkeypatch.setattr(dm, "BLOCK_ELEMENTS", 800)  # several blocks
    got = classes(docs_of(spark, texts))
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_links_in_block_equals_all_pairs():
    rng = np.random.default_rng(3)
    sets = [rng.choice(60, rng.integers(1, 40), replace=False).astype(np.int64) for _ in range(30)] + [np.arange(30), np.arange(33)]
    ids, side = np.arange(32), np.full(32, 3)
    out = dm.links_in_block(ids, ids, sets, side, 0.8)
    linked = {(i, j) for i in range(32) for j in range(32) if i != j and len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))}
    assert all(p in linked for p in out) and bool(out) == bool(linked) and ((30, 31) in out or (31, 30) in out)


def test_repeated_ids_null_ids_and_empty_tables(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    rows = [(1, a), (1, b), (2, a), (3, b), (None, a), (4, "x"), (4, "x"), (5, None)]
    assert classes(spark.createDataFrame(rows, "doc_id long, text string")) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert classes(spark.createDataFrame([], DOCS)) == {}


def test_repeated_ids_against_brute_force(spark):
    """Classes of ids as components over ids and linked texts; texts of null ids link too."""
    rng = random.Random(21)
    bases = [words(rng, n) for n in (12, 50, 90)]
    rows = [(rng.choice([None, *range(25)]), edited(rng, rng.choice(bases), rng.choice([0, 1, 2, 8]))) for _ in range(60)] + [(90, None), (91, ""), (91, "one two")]
    of_text = brute([t for _, t in rows])
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, ((d, _), c) in enumerate(zip(rows, of_text, strict=True)):
        for x, y in ([(("id", d), ("text", c))] if d is not None else []) + [(("text", c), ("text", of_text[i]))]:
            root[find(x)] = find(y)
    ids = {d for d, _ in rows if d is not None}
    want = {d: min(e for e in ids if find(("id", e)) == find(("id", d))) for d in ids}
    assert classes(spark.createDataFrame(rows, "doc_id long, text string")) == want


@pytest.mark.parametrize("n", [300])
def test_many_exact_copies(spark, n):
    got = classes(docs_of(spark, ["one two three four five six"] * n))
    assert set(got.values()) == {0} and len(got) == n


def test_texts_of_a_repeated_id_are_linked_each(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for i in range(0, 100, 10):
        one, two = words(rng, 60, f"a{i}x"), words(rng, 60, f"b{i}x")
        three, four = words(rng, 60, f"c{i}x"), [*two, "more"]
        rows += [(i + 5, " ".join(one)), (i + 5, " ".join(two)), (i + 6, " ".join(two)), (i + 8, " ".join(four)), (i + 9, " ".join(three)), (i + 7, " ".join([*one, "more"]))]
        want |= {i + 5: i + 5, i + 6: i + 5, i + 7: i + 5, i + 8: i + 5, i + 9: i + 9}
    assert classes(spark.createDataFrame(rows, "doc_id long, text string")) == want
