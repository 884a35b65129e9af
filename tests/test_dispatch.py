import pytest
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import dispatch, sampling
from millrace.plans import config


def test_registry():
    r = dispatch.Registry()
    r.register("a")(len)
    assert r["a"]([1, 2]) == 2
    with pytest.raises(ValueError, match="taken"):
        r.register("a")(max)
    r.register("a", overwrite=True)(max)
    assert r["a"]([1, 2]) == 2


def test_sent_to_all_only_if_small(spark):
    assert dispatch.to_all(spark.range(3), spark.range(2).toDF("k")).count() == 6
    with pytest.raises(ValueError, match="not sent"):
        dispatch.to_all(spark.range(3), spark.range(2).toDF("k"), most=1)
    assert dispatch.on_driver(spark.range(4), lambda d: d.count()) == 4


def test_configurations():
    good = {"train_batch": 8, "samples": 4, "ranks": 4, "mini": 16, "micro": 8}
    config.validate(good)
    config.validate({**good, "micro": None, "dynamic": True})
    for change, said in ({"ranks": 3}, "divisible"), ({"mini": 64}, "larger"), ({"micro": None}, "needed"), ({"micro_per_rank": 1}, "exclude"), ({"micro": 12}, "mini is not"), ({"estimator": "gae", "critic": False}, "critic"):
        with pytest.raises(ValueError, match=said):
            config.validate(good | change)


def test_wide_sample_and_runs(spark):
    df = spark.range(5).select(F.col("id").alias("row"), F.concat(F.lit("x"), "id").alias("v"))
    r = sampling.wide_sample(df, 2, ["row", "v"], "row", 7).first()
    assert r.step == 2 and sorted(x for x in (r[f"row_{i}"] for i in range(1, 8)) if x is not None) == list(range(5)) and r.v_6 is None
    got = spark.createDataFrame([("abababxcc",)], "t string").select(text.regex_runs(F.col("t")).alias("r")).first().r
    assert [tuple(x) for x in got] == [("ab", 3), ("c", 2)]
