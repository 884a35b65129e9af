import numpy as np

from millrace.llm import ann


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id string, v string, list string")


def rows_of(x, start=0):
    return [(i + start, [float(c) for c in r], 0, "clash", "clash", "clash") for i, r in enumerate(x)]


def exact(x, ids, q, k=10):
    d = np.sqrt(((x.astype(np.float32).astype(float) - x[q].astype(np.float32).astype(float)) ** 2).sum(axis=1))
    return [(ids[j], d[j]) for j in np.lexsort((ids, d)) if ids[j] != ids[q]][:k]


def test_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24)) + rng.normal(size=(12, 24))[rng.integers(0, 12, 3000)] * 2
    df = table(spark, rows_of(x))
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in range(0, 3000, 100):
        want = exact(x, np.arange(3000), q)
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(abs(m[2] - exact(x, np.arange(3000), q, 3000)[[w[0] for w in exact(x, np.arange(3000), q, 3000)].index(m[1])][1]) < 1e-12 for m in mine[:2])
        hits += len({m[1] for m in mine} & {w[0] for w in want})
    assert hits >= 0.9 * 300


def test_ties_repeats_and_hot_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 50)
    x = np.concatenate([np.tile([1.0, 2.0, 3.0], (400, 1)), np.random.default_rng(1).normal(size=(100, 3))])
    df = table(spark, rows_of(x))
    got = ann.nearest(df.union(df.where("vec_id < 3")), df.where("vec_id = 100")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(10)) and all(r.score == 0 for r in got)


def test_invalid_vectors_take_no_part(spark):
    bad = [(50, None, 0, "", "", ""), (51, [0.0, 0.0], 0, "", "", ""), (52, [1.0, None], 0, "", "", ""), (53, [float("nan"), 1.0], 0, "", "", ""), (54, [float("inf"), 1.0], 0, "", "", ""), (55, [1.0], 0, "", "", ""), (None, [1.0, 1.0], 0, "", "", ""), (56, [], 0, "", "", "")]
    good = rows_of([[1, 0], [0, 1], [1, 1]])
    df = table(spark, good + bad)
    got = ann.nearest(df, df).collect()
    assert {r.query_id for r in got} == {0, 1, 2} and {r.vec_id for r in got} == {0, 1, 2}
    assert len(got) == 6 and all(r.query_id != r.vec_id for r in got)


def test_empty_and_single(spark):
    df = table(spark, rows_of([[1, 0]]))
    assert ann.nearest(df.where("false"), df).count() == 0
    assert ann.nearest(df, df).count() == 0
    assert ann.nearest(df, df.where("false")).count() == 0


def test_graph_search_finds_the_nearest_centroids():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 16))
    lists = ann.fit(x, 200)
    row, at, home = lists.assign(x)
    held = np.bincount(at[home], minlength=200)
    assert sorted(row[home].tolist()) == list(range(2000)) and np.bincount(row).max() <= ann.COPIES
    assert held.max() < 6 * held.mean()
    lists.ratio, lists.most = 1.4, 20
    hits = total = 0
    for q in x[:50]:
        d = np.sqrt(((lists.centroids - q) ** 2).sum(axis=1))
        want = {c for c in np.argsort(d)[:20].tolist() if d[c] <= 1.4 * d.min()}
        hits, total = hits + len(set(lists.search(q, held, 11).tolist()) & want), total + len(want)
    assert hits >= 0.95 * total


def test_search_goes_on_until_there_are_enough(spark):
    rng = np.random.default_rng(6)
    far = np.concatenate([rng.normal(size=(3000, 16)), 500 + 0.01 * rng.normal(size=(5, 16))])  # an isolated group of 5
    df = table(spark, rows_of(far))
    got = {}
    for r in ann.nearest(df, df.where("vec_id >= 3000 OR vec_id < 5")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert sorted(got) == [0, 1, 2, 3, 4, 3000, 3001, 3002, 3003, 3004]
    for q, found in got.items():
        assert [k for k, _ in sorted(found)] == list(range(1, 11))
        if q >= 3000:
            assert {v for _, v in sorted(found)[:4]} == set(range(3000, 3005)) - {q}


def test_repeated_ids_count_once(spark):
    rng = np.random.default_rng(7)
    near = rng.normal(size=(2000, 8))
    rows = rows_of(near) + [(5000, [float(c) for c in 300 + 0.01 * rng.normal(size=8)], 0, "", "", "") for _ in range(40)] + [(5001, [300.0] * 8, 0, "", "", "")]
    df = table(spark, rows)  # 40 vectors of one id around the query
    got = sorted((r.rank, r.vec_id) for r in ann.nearest(df, df.where("vec_id = 5001")).collect())
    assert [k for k, _ in got] == list(range(1, 11)) and got[0][1] == 5000 and len({v for _, v in got}) == 10


def test_share_of_compared_rows_falls():
    rng = np.random.default_rng(8)
    shares = []
    for n in (2000, 20000):
        x = rng.normal(size=(200, 32))[rng.integers(0, 200, n)] + 0.5 * rng.normal(size=(n, 32))
        out = n // 4
        lists = ann.fit(x[out:], max(1, len(x[out:]) // ann.POINTS))
        found = [ann.fit_search(lists, x[:out], 10), ann.fit_search(lists, x[: 2 * out], 10)]
        lists.ratio, lists.most = max(r for r, _ in found) * ann.WIDER, max(m for _, m in found) + ann.MORE
        _, at, home = lists.assign(x)
        sizes, held = np.bincount(at, minlength=len(lists.centroids)), np.bincount(at[home], minlength=len(lists.centroids))
        shares.append(np.mean([sizes[lists.search(q, held, 11)].sum() / n for q in x[:100]]))
    assert shares[1] < 0.3 and shares[1] < shares[0] / 2


def test_queries_unlike_most_vectors_miss_nothing(spark):
    rng = np.random.default_rng(9)
    x = 5 * rng.normal(size=(60, 24))[rng.integers(0, 60, 6000)] + 0.2 * rng.normal(size=(6000, 24))
    x[::100] = 4 * rng.normal(size=(60, 24))  # between the groups, where the fitted sample has next to nothing
    for moved in (0.0, 1e4):  # and far from zero
        y = x + moved
        df = table(spark, rows_of(y))
        got = {}
        for r in ann.nearest(df, df.where("vec_id % 100 = 0")).collect():
            got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
        for q in range(0, 6000, 100):
            want = exact(y, np.arange(6000), q)
            assert [got[q][k][0] for k in range(1, 11)] == [w[0] for w in want] and np.allclose([got[q][k][1] for k in range(1, 11)], [w[1] for w in want])
