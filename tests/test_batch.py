import pytest
from pyspark.sql import functions as F

from millrace.operators import batch, sampling


@pytest.fixture(scope="module")
def ten(spark):
    return spark.range(10).select(F.col("id").alias("row_id"), (F.col("id") * 10).alias("x"))


def order(df, column="row_id"):
    return [r[column] for r in df.orderBy("row_id").collect()]


@pytest.mark.parametrize("s", [slice(None), slice(2, 7), slice(-3, None), slice(None, -4), slice(1, 9, 3), slice(None, None, 4), slice(-8, -1, 2), slice(8, 2, -2), slice(5, 5), slice(0, 100, 3)])
def test_slices_are_pythons(ten, s):
    assert order(batch.slice_rows(ten, s.start, s.stop, s.step or 1)) == sorted(range(10)[s])


@pytest.mark.parametrize(("n", "k", "ceil", "even"), [(5, 4, [2, 2, 1], [2, 1, 1, 1]), (10, 4, [3, 3, 3, 1], [3, 3, 2, 2]), (3, 5, [1, 1, 1], [1, 1, 1]), (0, 3, [], [])])
def test_chunks(spark, n, k, ceil, even):
    df = spark.range(n).withColumnRenamed("id", "row_id")
    for sizing, want in (("ceil", ceil), ("even", even)):
        got = batch.chunk(df, k, sizing).groupBy("part").count().orderBy("part").collect()
        assert [r["count"] for r in got] == want


def test_repeats(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "row_id long, v string")
    assert "".join(order(batch.repeat(df, 2), "v")) == "aabb"
    assert "".join(order(batch.repeat(df, 2, interleave=False), "v")) == "abab"


def test_padding_cycles_and_unpads(spark, ten):
    five = spark.range(5).withColumnRenamed("id", "row_id").withColumn("v", F.col("row_id"))
    out, pad = batch.pad_to_divisor(five, 4)
    assert pad == 3 and order(out, "v") == [0, 1, 2, 3, 4, 0, 1, 2]
    out, pad = batch.pad_to_divisor(five, 13)
    assert pad == 8 and order(out, "v") == [0, 1, 2, 3, 4, 0, 1, 2, 3, 4, 0, 1, 2]
    assert order(batch.unpad(out, pad)) == [0, 1, 2, 3, 4]
    assert batch.pad_to_divisor(ten.where("false"), 4)[1] == 0


def test_union_checks_values(spark):
    a = spark.createDataFrame([(0, 1.0, None), (1, float("nan"), "x")], "row_id long, v double, s string")
    assert batch.union_columns(a, a.withColumn("w", F.lit(1))).count() == 2
    with pytest.raises(Exception, match="column v differs"):
        batch.union_columns(a, a.withColumn("v", F.lit(2.0))).collect()


def test_errors(spark, ten):
    with pytest.raises(KeyError):
        batch.pop(ten, ["y"])
    with pytest.raises(ValueError, match="as many"):
        batch.rename(ten, ["x"], [])
    with pytest.raises(ValueError, match="columns that"):
        batch.concat(ten, ten.withColumn("z", F.lit(1)))
    with pytest.raises(ValueError, match="divisible"):
        batch.minibatches(ten, 3)
    with pytest.raises(ValueError, match="divisible"):
        batch.fold(ten, 3)
    with pytest.raises(ValueError, match="positions"):
        batch.check_consistent(ten.where("row_id <> 3"))
    batch.check_consistent(ten)


def test_take_keeps_order_and_repeats(spark, ten):
    wanted = spark.createDataFrame([(0, 7), (1, 2), (2, 7)], "position long, row_id long")
    assert order(batch.take(ten, wanted), "x") == [70, 20, 70]


def test_permutations(spark):
    p = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "position long, value long")
    assert sorted(map(tuple, batch.inverse_permutation(p).collect())) == [(0, 1), (1, 2), (2, 0)]


def test_numbering_is_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(6)
    assert [(r.k, r.row_id) for r in batch.numbered(df, "k").orderBy("k").collect()] == [(i, i) for i in range(1000)]


def test_shuffled_minibatches(spark, ten):
    rows = batch.minibatches(ten, 5, 2, seed=3).collect()
    for e in (0, 1):
        assert sorted(r.row_id for r in rows if r.epoch == e) == list(range(10))
        assert [sum(r.batch == b for r in rows if r.epoch == e) for b in (0, 1)] == [5, 5]


def test_picks(spark):
    df = spark.createDataFrame([(g, i, int(i % 3 == 0), i) for i in range(30) for g in [i % 4]], "g int, row long, flag int, v long")
    assert sampling.one_per_group(df, "g", "row").count() == 4
    assert all(r.flag == 1 for r in sampling.kept_else_any(df, "g", "flag", "row").collect())
    assert {r.row for r in sampling.one_per_group(df, "g", "row").collect()} == {r.row for r in sampling.one_per_group(df.repartition(5), "g", "row").collect()}
    out = sampling.stratified(df, F.col("g"), {1: 0.5, 2: 0.0}, "row").groupBy("g").count().collect()
    assert {r.g: r["count"] for r in out} == {0: 8, 1: 4, 3: 7}
    assert sampling.at_most(df, 100, "row").count() == 30


def test_top_k_keeps_ties(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0, 2.0],), ([1.0],)], "x array<double>")
    assert [r.k for r in df.select(sampling.top_k_mask(F.col("x"), 2).alias("k")).collect()] == [[3.0, None, 2.0, 2.0], [1.0]]
