import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import sequence
from millrace.functions.scan import scanned, scanned_back
from millrace.operators import advantage, balance, groups, losses
from millrace.plans import rollout
from millrace.streaming import carry


def out(spark, column, kinds, *values):
    return spark.createDataFrame([values], kinds).select(column.alias("out")).first().out


def by_group(spark, f, *scores):
    df = spark.createDataFrame([(0, float(s)) for s in scores], "g int, s double")
    return sorted(r.advantage for r in f(df, "g", "s").collect())


def test_group_advantages(spark):
    assert by_group(spark, advantage.group_relative, 0.7) == [pytest.approx(0.7 / (1 + 1e-6))]
    assert by_group(spark, advantage.group_relative, 1, 1, 1) == [0, 0, 0]
    x = 0.5 / (math.sqrt(0.5) + 1e-6)
    assert by_group(spark, advantage.group_relative, 1, 0) == [pytest.approx(-x), pytest.approx(x)]
    assert by_group(spark, advantage.leave_one_out, 1, 0) == [-1, 1] and by_group(spark, advantage.leave_one_out, 3) == [3]


def test_recursions(spark):
    k = "r array<double>, v array<double>, m array<int>"
    got = out(spark, advantage.gae(F.col("r"), F.col("v"), 0.9, 0.95), k, [0.0, 0.0, 1.0], [0.1, 0.2, 0.3], [1, 1, 1])
    assert got == pytest.approx([0.6515675, 0.6685, 0.7])
    assert out(spark, advantage.discounted(F.col("r"), F.col("m"), 0.5), k, [1.0, 1.0, 1.0], [], [1, 0, 1]) == [1.0, 1.5, 1.0]
    assert out(spark, advantage.suffix_sums(F.col("r"), F.col("m")), k, [1.0, 2.0, 4.0], [], [1, 0, 1]) == [5, 4, 4]


def test_decoupled_recursion_equals_a_loop(spark):
    r, v, m = [0.1, 0.0, 0.0, 1.0, 0.5], [0.3, 0.2, 0.4, 0.1, 0.6], [1, 0, 0, 1, 1]
    df = spark.createDataFrame([(r, v, m)], "r array<double>, v array<double>, m array<int>")
    got = advantage.decoupled_gae(df, "r", "v", "m", 0.9, 0.8, 0.5).first()

    def loop(lam):
        settled, nxt, a, res = list(v), 0.0, 0.0, [0.0] * 5
        for t in reversed(range(5)):
            if m[t] == 0:
                settled[t] = nxt
            else:
                a = r[t] + 0.9 * nxt - settled[t] + 0.9 * lam * a
            res[t], nxt = a, settled[t]
        return res, settled

    target, settled = loop(0.8)
    assert got.returns == pytest.approx([x + y for x, y in zip(target, settled, strict=True)])
    assert got.advantages == pytest.approx(loop(max(1 - 1 / 2.5, 0.9))[0])


@pytest.mark.parametrize("name", advantage.ESTIMATORS)
def test_estimators(spark, name):
    df = spark.createDataFrame([("u", 1.0, [0.0, 1.0], [1, 1], [0.1, 0.2], [1, 1], 0.5), ("u", 0.0, [0.0, 0.0], [1, 0], [0.1, 0.2], [1, 0], 0.5)], "uid string, score double, rewards array<double>, mask array<int>, values array<double>, tool_mask array<int>, baseline double")
    rows = advantage.advantages(df, name).collect()
    assert len(rows) == 2 and all(len(r.advantages) == 2 and len(r.returns) == 2 for r in rows)
    with pytest.raises(ValueError, match="no estimator"):
        advantage.advantages(df, "none")


def test_group_filters_and_ratios(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 1.0), ("c", 1.0), ("d", -0.5), ("d", -0.5)], "g string, m double")
    assert {r.g for r in groups.group_variance(df, "g", "m").collect()} == {"b", "c"}
    assert tuple(groups.outcome_ratios(df.where("g = 'd'"), "g", "m").first()) == (0, 0, 0)
    kept = groups.keep_flags(df.withColumn("f", (F.col("m") == 1).cast("int")), "g", "f", 0.5).groupBy("g").agg(F.sum("kept")).collect()
    assert dict(map(tuple, kept)) == {"a": 2, "b": 1, "c": 1, "d": 0}
    with pytest.raises(Exception, match="two values"):
        df.limit(1).agg(groups.masked_var(F.col("m"), F.lit(1))).collect()


@pytest.mark.parametrize(("n", "name"), [(1999, "<2000"), (2000, "2000~5000"), (13999, "11000~14000"), (14000, ">14000")])
def test_length_buckets(spark, n, name):
    assert out(spark, groups.length_bucket(F.col("n")), "n int", n) == name


def test_losses(spark):
    assert out(spark, losses.divergence(F.col("a"), F.col("b"), "low_var_kl"), "a double, b double", 1.0, 1.0) == 0
    assert out(spark, losses.divergence(F.col("a"), F.col("b"), "low_var_kl"), "a double, b double", -50.0, 0.0) == 10
    with pytest.raises(NotImplementedError):
        losses.divergence(F.lit(0), F.lit(0), "full")
    x = [1000.0, 1001.0]
    assert out(spark, losses.log_sum_exp(F.col("x")), "x array<double>", x) == pytest.approx(1001 + math.log(1 + math.exp(-1)))
    steps = losses.adaptive_coefficient(spark.createDataFrame([(0, 1.0, 10), (1, 0.1, 10)], "s long, k double, n int"), "s", "k", "n", 0.2, 0.5, 100.0).orderBy("step").collect()
    assert [r.coefficient for r in steps] == pytest.approx([0.2 * 1.02, 0.2 * 1.02 * 0.98])


def test_token_arrays(spark):
    ids = "x array<bigint>"
    assert out(spark, sequence.end_mask(F.col("x"), 1), ids, [0, 0, 2, 42, 3, 5, 1, 0, 0]) == [1] * 7 + [0, 0]
    assert out(spark, sequence.end_mask(F.col("x"), 1, 3), ids, [4, 3, 1]) == [1, 1, 0] and out(spark, sequence.end_mask(F.col("x"), 9), ids, [4]) == [1]
    assert out(spark, sequence.position_ids(F.col("x")), ids, [0, 0, 1, 1, 1]) == [0, 0, 0, 1, 2]
    assert out(spark, sequence.padded(F.col("x"), 4, 9, left=True), ids, [1, 2]) == [9, 9, 1, 2] and out(spark, sequence.padded(F.col("x"), 1, 9), ids, [1, 2]) == [1, 2]
    with pytest.raises(Exception, match="longer than 2"):
        out(spark, sequence.fitted(F.col("x"), 2, 0), ids, [1, 2, 3])
    assert out(spark, sequence.from_first_token(F.col("x"), 0), ids, [0, 0, 5, 0]) == [5, 0] and out(spark, sequence.from_first_token(F.col("x"), 0), ids, [0]) == []
    assert out(spark, sequence.answer_loss_mask(F.col("x"), F.lit(2)), ids, [1, 1, 1, 1, 0]) == [0, 1, 1, 0, 0]
    p = out(spark, sequence.preference_pair(F.col("x"), F.array(F.lit(5).cast("long")), F.array(F.lit(6).cast("long"), F.lit(7).cast("long")), 4, 0), ids, [1])
    assert p.input_ids == [[1, 5, 0, 0], [1, 6, 7, 0]] and p.attention_mask == [[1, 1, 0, 0], [1, 1, 1, 0]]
    d = spark.createDataFrame([(i, i % 3) for i in range(10)], "r long, n int")
    assert [x.cu_seqlen for x in sequence.packed_offsets(d, "n", "r", 4).orderBy("r").collect()] == [0, 0, 1, 3, 3, 4, 6, 6, 7, 9, 9]


def test_balance(spark):
    lengths = [8, 7, 6, 5, 4, 3, 2, 1, 9, 10, 30, 1]
    for equal in (False, True):
        parts = balance.differencing(lengths, 4, equal)
        assert sorted(i for p in parts for i in p) == list(range(12)) and all(parts)
        assert not equal or all(len(p) == 3 for p in parts)
    sums = sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in balance.differencing([8, 7, 6, 5, 4], 2))
    assert sums == [14, 16]
    assert balance.greedy([3, 1, 1, 1], 2) == [[0], [1, 2, 3]]
    with pytest.raises(ValueError, match="fewer"):
        balance.differencing([1], 2)
    df = spark.createDataFrame([(b, i, (i * 37) % 50 + 1) for b in range(3) for i in range(20)], "b int, i long, n int")
    rows = balance.micro_batches(df, "b", "n", "i", 200).collect()
    assert len(rows) == 60 and len({r.part_id for r in rows}) == max(-(-sum(r.n for r in rows if r.b == b) // 200) for b in range(3))


def test_tool_loop_rounds_budget_and_failures(spark):
    prompts = spark.range(3).withColumnRenamed("id", "row_id")
    code = "```python\nprint(1)\n```"

    def generate(active, k):
        return active.select("row_id", F.when((F.col("row_id") == 0) | (F.lit(k) == 2), "done").otherwise(code).alias("output"))

    def execute(calls, k):
        return calls.select("row_id", F.when(F.col("row_id") == 2, 1).otherwise(0).alias("return_code"), F.lit("7").alias("stdout"), F.lit("ValueError: x").alias("stderr"))

    got = {r.row_id: r for r in rollout.tool_loop(prompts, generate, execute, 5).collect()}
    assert got[0].response == "done" and got[0].passes == []
    assert got[1].passes == [1, 1] and got[1].response.endswith("done") and got[1].response.count("```output\n7") == 2
    assert got[2].passes == [0] and "ValueError: x" in got[2].response
    s = got[1].ranges[0]
    assert got[1].response[s.s : s.e] == "\n```output\n7\n```\n"
    assert {len(r.passes) for r in rollout.tool_loop(prompts, generate, execute, 5, stop_on_failure=False, budget=1).collect()} == {0, 1}


def test_carry_over(spark):
    df = spark.createDataFrame([(0, 3), (1, 4), (2, 5), (3, 1)], "o long, n long")
    assert [tuple(r) for r in carry.carried(df, "o", "n", 6).orderBy("o").collect()] == [(0, 3, False), (1, 7, True), (2, 5, False), (3, 6, True)]


def test_carry_over_many_batches(spark):
    r = random.Random(1)
    xs = [(3 * i + 1, r.choice([0, 0, 1, 2, 5, 9, None])) for i in range(300)]
    want, held = [], 0
    for o, n in xs:
        held += n or 0
        want.append((o, held, held >= 17))
        held = 0 if held >= 17 else held
    df = spark.createDataFrame(r.sample(xs, len(xs)), "o long, n long")
    assert [tuple(x) for x in carry.carried(df, "o", "n", 17).orderBy("o").collect()] == want
    assert carry.carried(df.limit(0), "o", "n", 17).count() == 0


def test_coefficients_over_buckets(spark):
    r = random.Random(2)
    xs = [(i, r.uniform(0, 1), r.randrange(1, 50)) for i in range(200)]
    value, want = 0.2, []
    for _, k, n in xs:
        value *= 1 + max(-0.2, min(0.2, k / 0.5 - 1)) * n / 100.0
        want.append(value)
    got = losses.adaptive_coefficient(spark.createDataFrame(r.sample(xs, 200), "s long, k double, n int"), "s", "k", "n", 0.2, 0.5, 100.0, bucket_rows=16).orderBy("step").collect()
    assert [x.coefficient for x in got] == pytest.approx(want, rel=1e-12)


def test_carry_over_a_stream(spark, tmp_path):
    for i in range(4):
        spark.createDataFrame([(f"g{i}{j}", i) for j in range(3)], "uid string, v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    sink = carry.CarryOver("uid", 5, lambda df, i: seen.append(df.count()))
    q = spark.readStream.schema("uid string, v int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert seen == [6, 6]
    sink(spark.createDataFrame([("x", 1)], "uid string, v int"), 0)
    assert seen == [6, 6] and sink.marked(spark) == (3, 4)


def test_carry_over_survives_a_restart(spark, tmp_path):
    batch = lambda i: spark.createDataFrame([(f"g{i}{j}", i) for j in range(3)], "uid string, v int")
    seen = []
    for i in range(4):  # a new sink for each batch, as after a restart; the last batch comes twice
        carry.CarryOver("uid", 8, lambda df, k: seen.append((k, df.count())), str(tmp_path / "state"))(batch(i), i)
    carry.CarryOver("uid", 8, lambda df, k: seen.append((k, df.count())), str(tmp_path / "state"))(batch(3), 3)
    assert seen == [(2, 9)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 17, 100])
def test_scans_of_any_length(spark, n):
    df = spark.createDataFrame([(list(range(n)),), (None,)], "x array<int>")
    sums = scanned(F.col("x"), F.lit(0).cast("long"), lambda s, x: s + x, lambda s: s, "bigint")
    back = scanned_back(F.col("x"), F.lit(0).cast("long"), lambda s, x: s + x, lambda s: s, "bigint")
    got = df.select(sums.alias("a"), back.alias("b")).collect()
    assert got[0].a == [sum(range(i + 1)) for i in range(n)] and got[0].b == [sum(range(i, n)) for i in range(n)]
    assert got[1].a is None and got[1].b is None


def test_a_long_response_is_no_quadratic_fold(spark):
    n = 100_000
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.lit(1.0)).alias("r"))
    got = df.select(advantage.gae(F.col("r"), F.col("r"), 1.0, 1.0).alias("a")).first().a
    assert len(got) == n and got[-1] == 0.0 and got[0] == n - 1


def test_token_budget_in_buckets(spark):
    rows = [(b, i, (i * 7 + b) % 5) for b in range(2) for i in range(300)]
    df = spark.createDataFrame(rows, "b int, i long, n long")
    got = {(r.b, r.i): r.micro for r in balance.token_budget(df, "b", "n", "i", 37, bucket_rows=50).collect()}
    for b in range(2):
        total = 0
        for _, i, n in rows[b * 300 : b * 300 + 300]:
            total += n
            assert got[b, i] == (total - 1) // 37


def test_snapped_windows_against_all_cuts(spark):
    r = random.Random(5)
    rows = [(i, list(range(r.randrange(0, 60))), r.sample(range(60), r.randrange(0, 25))) for i in range(60)] + [(60, list(range(9)), None), (61, list(range(9)), [3, None])]
    df = spark.createDataFrame(rows, "i int, t array<int>, c array<int>")
    for x in df.select("i", sequence.snapped_windows(F.col("t"), F.col("c"), 10, 4, 2).alias("w")).collect():
        _, t, cuts = rows[x.i]
        cuts = [c for c in cuts or [] if c is not None]
        ends = [(s, min((abs(c - min(s + 10, len(t))), c) for c in cuts)[1] if cuts else min(s + 10, len(t))) for s in range(0, len(t), 4)]
        assert x.w == [t[s:e] for s, e in ends if len(t[s : max(s, e)]) >= 2]


def test_a_large_batch_is_balanced_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(balance, "BLOCK", 50)
    df = spark.range(1203).selectExpr("id % 3 AS b", "id AS i", "1 + id * id % 97 AS n")
    blocks = balance._blocks
    held = []
    monkeypatch.setattr(balance, "_blocks", lambda ids, *a, **k: held.append(ids.groupBy("batch", "block").count().agg(F.max("count")).first()[0]) or blocks(ids, *a, **k))
    for method, equal, data in (("differencing", False, df), ("greedy", False, df), ("differencing", True, df.where("i < 1200"))):
        got = balance.balanced(data, "b", "n", "i", 8, equal, method).collect()
        assert sorted(r.i for r in got) == [r.i for r in data.orderBy("i").collect()]
        for b in range(3):
            rows = [r for r in got if r.b == b]
            sums, sizes = [[f(r.n for r in rows if r.part_id == k) for k in range(8)] for f in (sum, lambda x: len(list(x)))]
            assert max(sums) - min(sums) <= max(r.n for r in rows) and (not equal or len(set(sizes)) == 1)
    assert max(held) < 100  # of 401 rows of a batch


def test_tool_loop_deals_many_rows_over_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(rollout, "ROWS", 50)
    prompts = spark.range(1000).select(F.col("id").alias("row_id"))
    generate = lambda active, k: active.select("row_id", F.when((F.col("row_id") % 3 == 0) & (F.lit(k) == 0), "```python\nx\n```").otherwise("end").alias("output"))
    execute = lambda calls, k: calls.select("row_id", F.lit(0).alias("return_code"), F.lit("1").alias("stdout"), F.lit("").alias("stderr"))
    got = rollout.tool_loop(prompts, generate, execute, 3)
    assert got.rdd.getNumPartitions() == 20
    rows = {r.row_id: r for r in got.collect()}
    assert len(rows) == 1000 and all(r.stop and r.passes == ([1] if i % 3 == 0 else []) and r.response.endswith("end") for i, r in rows.items())
