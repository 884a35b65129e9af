import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import whitening

TABLES = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>"


def by_hand(vectors):
    """n, S, covariance, eigenvalues and vectors of the distinct whole-number vectors, plainly."""
    x = np.array(sorted({tuple(math.floor(256 * float(c)) for c in v) for v in vectors}), dtype=object)
    n, s = len(x), x.sum(axis=0)
    centred = (x - s / n).astype(float)
    v = centred.T @ centred / n
    values, axes = np.linalg.eigh(v)
    return x, n, s, v, values[::-1], axes[:, ::-1].T


def test_symmetric_qr_against_lapack():
    rng = np.random.default_rng(3)
    cases = [np.zeros((3, 3)), np.eye(4) * 7, np.diag([3.0, 3.0, 1.0, 0.0]), np.array([[2.0]]), np.zeros((0, 0)), np.array([[0.0, 1.0], [1.0, 0.0]])]
    for n in (2, 3, 5, 17, 64):
        a = rng.normal(size=(n, n)) * 10.0 ** rng.integers(-3, 4)
        cases += [a + a.T, a @ a.T, np.outer(a[0], a[0]), np.diag(np.arange(n)) + np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)]
    for a in cases:
        values, rows = whitening.symmetric_qr(a)
        size = np.abs(a).max(initial=1e-300)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-13 * size * max(1, len(a)))
        assert np.allclose(rows @ rows.T, np.eye(len(a)), atol=1e-12)
        assert np.allclose(rows @ a, values[:, None] * rows, atol=1e-12 * size * max(1, len(a)))


def test_merged_moments_equal_those_of_the_whole():
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, size=(500, 6)) + np.int64(10) ** 9
    whole, parts = whitening.Moments(6), [whitening.Moments(6) for _ in range(4)]
    whole.add(x)
    for m, block in zip(parts, np.split(x, [1, 1, 200]), strict=True):
        m.add(block)
    for m in parts[1:]:
        parts[0].merge(m)
    centred = x - x.mean(axis=0)
    for m in (whole, parts[0]):
        assert m.n == 500 and m.sums() == x.sum(axis=0).tolist()
        assert np.allclose(m.covariance(), centred.T @ centred / 500, rtol=1e-9, atol=1e-5)


def test_op11_against_brute_force(spark):
    got = whitening.op11_whitening(spark, TABLES).collect()
    rows = spark.read.parquet(f"{TABLES}/embeddings.parquet").select("vec_id", "embedding").collect()
    _, n, s, v, values, axes = by_hand([r.embedding for r in rows])
    assert len(got) == 4 * len(rows)
    by = {(r.vec_id, r.component): r for r in got}
    signs = {}
    for r in rows:
        x = [math.floor(256 * float(c)) for c in r.embedding]
        for c in range(1, 5):
            g = by[r.vec_id, c]
            assert g.n == n and g.deviation == sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
            want = float((np.array(x) - s.astype(float) / n) @ axes[c - 1] / math.sqrt(values[c - 1]))
            sign = signs.setdefault(c, 1 if g.whitened * want > 0 else -1)
            assert g.whitened == pytest.approx(sign * want, rel=1e-8, abs=1e-8)
            assert g.explained == pytest.approx(values[c - 1] / np.trace(v), rel=1e-9)
            assert g.identity_error < 1e-9


def test_rows_without_a_vector_copies_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [1.0, None], [nan, 1.0], [inf, 0.0], [1e38, 0.0], [1.0, 2.0], [1.0, 2.0], [1.001, 2.0], [0.0, -1.0], [3.0, 1.0], [5.0]]
    df = spark.createDataFrame([(i if i != 8 else None, v, "a", i) for i, v in enumerate(vectors)], SCHEMA + ", whitened string, n int").repartition(5)
    out = whitening.whiten(df, whitening.fit(df)).select("vec_id", "n", F.col("whitened").alias("w")).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in out) == [(False, 6), (False, 7), (False, 9), (False, 10), (False, 11), (True, 0)]
    by = {r.vec_id: r.w for r in out}
    assert by[6] == by[7] == by[None] and len(by[6]) == 2 and by[6][0].n == 3
    assert len(by[11]) == 1 and by[11][0].whitened is None and by[11][0].explained is None and by[11][0].n == 1 and by[11][0].deviation == 0
    _, n, s, v, values, axes = by_hand([[1.0, 2.0], [0.0, -1.0], [3.0, 1.0]])
    for c in range(2):
        x = np.array([256, 512]) - s.astype(float) / n
        assert abs(by[6][c].whitened) == pytest.approx(abs(x @ axes[c]) / math.sqrt(values[c]))
    mean = [Fraction(int(t), n) for t in s]
    assert by[9][0].deviation == n * n * sum((a - m) ** 2 for a, m in zip([0, -256], mean, strict=True))


def test_copies_of_one_vector_and_an_empty_table(spark):
    df = spark.createDataFrame([(i, [0.5, 0.25, 1.0]) for i in range(40)], SCHEMA)
    out = whitening.whiten(df, whitening.fit(df)).selectExpr("inline(whitened)").collect()
    assert len(out) == 120 and all(r.whitened is None and r.n == 1 and r.deviation == 0 and r.identity_error is None for r in out)
    none = df.limit(0)
    assert whitening.whiten(none, whitening.fit(none)).count() == 0


def test_large_entries_are_exact(spark):
    rows = [(1, [2.0**40, 1.0]), (2, [-(2.0**40), 3.0]), (3, [2.0**41, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    p = whitening.fit(df)[2]
    assert p.n == 3 and p.sums == [256 * 2**41, 256 * 4]
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(df, {2: p}).select("vec_id", F.inline("whitened")).collect()}
    for i, v in rows:
        assert got[i] == sum((3 * int(256 * c) - s) ** 2 for c, s in zip(v, p.sums, strict=True))
