import dataclasses
import enum
import json
import random

from pyspark.sql import functions as F

from millrace.sources import files, json_array
from millrace.sources.tables import materialized


def test_json_arrays_and_lines(spark, tmp_path):
    df = spark.createDataFrame([(i, f"é{i}") for i in range(10)], "id long, q string")
    files.write_json_array(df.repartition(3), str(tmp_path / "a"))
    assert all(isinstance(json.loads(p.read_text()), list) for p in (tmp_path / "a").glob("part*") if p.stat().st_size)
    assert sorted(r.q for r in files.read_json_array(spark, str(tmp_path / "a"), "id long, q string").collect()) == [f"é{i}" for i in range(10)]
    files.append_json_lines(df, str(tmp_path / "l"))
    files.append_json_lines(df, str(tmp_path / "l"))
    assert files.read_json_lines(spark, str(tmp_path / "l")).count() == 20


def test_one_json_array_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(6)
    text = lambda: "".join(rng.choices('ab"\\\\{}[],:\n é', k=rng.randrange(0, 60)))
    value = lambda d: rng.choice([text(), rng.randrange(99), None, True, [text()] if d else [], {text(): value(d - 1)} if d else {}])
    rows = [{"id": i, "q": text(), "more": value(3)} for i in range(120)]
    files_ = {"a": json.dumps(rows), "b": json.dumps(rows, indent=2, ensure_ascii=False), "c": "[]", "d": json.dumps([value(2) for _ in range(50)]), "e": " [ 1, [2, 3] , \"x,]}\" ]\n", "f": "[" + json.dumps(rows[:3]) + "]"}
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (400, 1 << 20):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        try:
            for name, whole in files_.items():
                (tmp_path / name).write_text(whole)
                found = json_array.elements(spark, str(tmp_path / name))
                got = {r.row_id: json.loads(r.value) for r in found.collect()}
                assert got == dict(enumerate(json.loads(whole))), (name, size)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    try:
        parts = json_array._parts(spark, str(tmp_path / "b"))
        assert parts.rdd.getNumPartitions() > 20 and parts.where("NOT whole").count() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    got = json_array.read_array(spark, str(tmp_path / "a"), "id long, q string").orderBy("row_id").collect()
    assert [(r.id, r.q) for r in got] == [(x["id"], x["q"]) for x in rows]


def test_prompts_preferences_and_nested_keys(spark, tmp_path):
    df = spark.createDataFrame([("p", "c", "r", {"style": "rule", "truth": ["4"]})], "prompt string, chosen string, rejected string, reward_model struct<style:string,truth:array<string>>")
    df.write.parquet(str(tmp_path / "x"))
    assert files.read_prompts(spark, [str(tmp_path / "x")] * 2).count() == 2
    assert files.read_preferences(spark, [str(tmp_path / "x")]).columns == ["prompt", "chosen", "rejected"]
    assert files.nested(df, "reward_model", "truth").first().value == "4"


def test_responses_and_samples(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "c")], "prompt int, k int, response string")
    files.write_responses(df, str(tmp_path / "r"), "prompt", "response", "k")
    assert {r.prompt: r.responses for r in spark.read.parquet(str(tmp_path / "r")).collect()} == {1: ["a", "b"], 2: ["c"]}
    s = spark.createDataFrame([("train", 1, "p", "r", [0.0, 0.5, 0.0], "x"), ("val", 1, "p", "r", [0.0], "y")], "split string, step int, prompt string, response string, token_level_scores array<double>, source string")
    files.write_samples(s, str(tmp_path / "s"))
    assert {r.split: r.reward for r in spark.read.json(str(tmp_path / "s")).collect()} == {"train": 0.5, "val": 0.0}


def test_text_with_fallback(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("é".encode())
    (tmp_path / "l.txt").write_bytes("é".encode("latin1"))
    assert [r.text for r in files.read_text(spark, str(tmp_path / "*.txt")).collect()] == ["é", "é"]


def test_checkpoints_and_versions(spark):
    df = spark.createDataFrame([("a/global_step_9",), ("a/global_step_10",), ("other",)], "path string")
    assert tuple(files.latest_checkpoint(df).first()) == ("a/global_step_10", 10)
    assert files.latest_checkpoint(df.where("path = 'other'")).count() == 0
    assert files.versioned(["run", "run_2", "runner"], "run") == "run_3"


def test_flat_configurations():
    class Kind(enum.Enum):
        A = "a"

    @dataclasses.dataclass
    class Part:
        k: Kind
        xs: list

    assert files.flatten_config({"p": Part(Kind.A, [1, {"z": 2}]), "n": None}) == {"p/k": "a", "p/xs/list_len": 2, "p/xs/0": 1, "p/xs/1/z": 2, "n": None}


def test_metrics(spark, tmp_path):
    rows = files.metric_rows(spark, 3, {"b": 2, "a": 0.12345})
    files.log_metrics(rows, str(tmp_path / "m"), str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == spark.read.parquet(str(tmp_path / "n")).count() == 2
    seen = []
    files.log_metrics(rows, ("json", str(tmp_path / "j")), ("csv", str(tmp_path / "c")), lambda r: seen.append(r.count()))
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.csv(str(tmp_path / "c")).count() == 2 and seen == [2]
    assert files.console_lines(rows).first().line == "step:3 - a:0.123 - b:2.000"


def test_materialized_tables_keep_rows(spark):
    df = spark.range(5).withColumn("x", F.array("id"))
    assert materialized(df, "t").orderBy("id").collect() == df.collect()
