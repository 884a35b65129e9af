"""Record files: JSON arrays, JSON lines, Parquet with list columns, checkpoint manifests, flattened configurations, metrics."""

from __future__ import annotations

import dataclasses
import enum
import re
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_prompts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Prompt tables, all paths as one scan."""
    return spark.read.parquet(*paths)


def nested(df: DataFrame, *keys: str, name: str = "value") -> DataFrame:
    """A nested field by successive keys; a one-element array is unwrapped."""
    field = T.StructField("", df.schema)
    out = None
    for k in keys:
        kind = field.dataType
        if isinstance(kind, T.ArrayType):
            out, kind = out[0], kind.elementType
        out = F.col(f"`{k}`") if out is None else out.getField(k)
        field = kind[k]
    if isinstance(field.dataType, T.ArrayType):
        out = out[0]
    return df.withColumn(name, out)


def read_preferences(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.parquet(*paths).select("prompt", "chosen", "rejected")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Files that are one JSON array each."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_text(spark: SparkSession, path: str, fallback: str = "iso-8859-1") -> DataFrame:
    """path and text of whole files: UTF-8, or the fallback charset where a file is none."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.select("path", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", fallback)).alias("text"))


def write_json_array(df: DataFrame, path: str) -> None:
    """JSON arrays, one for each partition, so that no task holds all rows; read_json_array reads the folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in batches:
            lines = b.column("value").to_pylist()
            if lines:
                out = ["[" if before is None else before + ",", *[x + "," for x in lines[:-1]]]
                before = lines[-1]
                yield pa.RecordBatch.from_pydict({"value": out})
        yield pa.RecordBatch.from_pydict({"value": ["[]"] if before is None else [before, "]"]})

    df.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(run, "value string").write.mode("overwrite").text(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_responses(df: DataFrame, path: str, key: str, response: str, order: str) -> None:
    """One row for each prompt with the list of its responses, in order."""
    lists = df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, response))), lambda x: x[response]).alias("responses"))
    lists.write.mode("overwrite").parquet(path)


def last_nonzero(scores: Column) -> Column:
    """The last non-zero of an array, else 0."""
    kept = F.filter(scores, lambda x: x != 0)
    return F.when(F.size(kept) > 0, F.element_at(kept, -1)).otherwise(F.lit(0.0))


def write_samples(df: DataFrame, path: str) -> None:
    """prompt, response, reward (the last non-zero token score) and source, by split and step."""
    out = df.select("split", "step", "prompt", "response", last_nonzero(F.col("token_level_scores")).alias("reward"), "source")
    out.write.mode("append").partitionBy("split", "step").json(path)


def checkpoint_step(path: Column) -> Column:
    """The number after global_step_, or null."""
    return F.regexp_extract(path, r"global_step_(\d+)", 1).try_cast("int")


def latest_checkpoint(manifest: DataFrame, path: str = "path") -> DataFrame:
    """path and step of the checkpoint of the largest step (no row: none)."""
    steps = manifest.select(F.col(path).alias("path"), checkpoint_step(F.col(path)).alias("step")).where("step IS NOT NULL")
    return steps.orderBy(F.desc("step"), "path").limit(1)


def versioned(existing: list[str], name: str) -> str:
    """A folder name with the number of like-named folders, and 1, after it."""
    return f"{name}_{sum(bool(re.fullmatch(re.escape(name) + r'(_\d+)?', e)) for e in existing) + 1}"


def next_versions(existing: DataFrame, name: str = "name") -> DataFrame:
    """base, n and next: of each name without its number how many folders there are, and the name of the next."""
    base = F.regexp_replace(F.col(name), r"_\d+$", "").alias("base")
    counted = existing.groupBy(base).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("base", "n", F.concat_ws("_", "base", (F.col("n") + 1).cast("string")).alias("next"))


def flat_entries(column: Column, kind: T.DataType, at: Column | None = None, sep: str = "/") -> Column:
    """flatten_config of a nested column: an array of struct(key, value), in the order of the fields."""
    under = lambda k: k if at is None else F.concat(at, F.lit(sep), k)
    leaf = lambda v, k: F.array(F.struct(k.alias("key"), v.cast("string").alias("value")))
    if isinstance(kind, T.StructType):
        out = F.flatten(F.array(*[flat_entries(column[f.name], f.dataType, under(F.lit(f.name)), sep) for f in kind.fields]))
    elif isinstance(kind, T.MapType):
        out = F.flatten(F.transform(F.map_entries(column), lambda e: flat_entries(e["value"], kind.valueType, under(e["key"].cast("string")), sep)))
    elif isinstance(kind, T.ArrayType):
        items = F.flatten(F.transform(column, lambda x, i: flat_entries(x, kind.elementType, under(i.cast("string")), sep)))
        out = F.concat(leaf(F.size(column), under(F.lit("list_len"))), items)
    else:
        return leaf(column, F.lit("") if at is None else at)
    return out if at is None else F.when(column.isNull(), leaf(F.lit(None), at)).otherwise(out)


def flatten_config(config: Any, sep: str = "/") -> dict[str, Any]:
    """Nested mappings, dataclasses and lists as flat keys; a list gives its length and its items by index, an enum its value."""
    out: dict[str, Any] = {}

    def walk(x: Any, at: str) -> None:
        if dataclasses.is_dataclass(x) and not isinstance(x, type):
            x = dataclasses.asdict(x)
        if isinstance(x, enum.Enum):
            x = x.value
        if isinstance(x, (list, tuple)):
            x = {"list_len": len(x)} | {str(i): v for i, v in enumerate(x)}
        if isinstance(x, Mapping):
            for k, v in x.items():
                walk(v, f"{at}{sep}{k}" if at else str(k))
        else:
            out[at] = x

    walk(config, "")
    return out


def metric_rows(spark: SparkSession, step: int, metrics: Mapping[str, float]) -> DataFrame:
    """A step's metrics as rows (step, key, value)."""
    return spark.createDataFrame([(step, k, float(v)) for k, v in metrics.items()], "step long, key string, value double")


def log_metrics(rows: DataFrame, *sinks: str | tuple[str, str] | Callable[[DataFrame], object]) -> None:
    """The same metric rows to each sink: a folder of Parquet files, (format, folder) of any other format that Spark writes, or a
    function of the rows (a tracker's client, console_lines)."""
    for s in sinks:
        if callable(s):
            s(rows)
        else:
            kind, folder = ("parquet", s) if isinstance(s, str) else s
            rows.write.mode("append").format(kind).save(folder)


def console_lines(rows: DataFrame) -> DataFrame:
    """step and its line: step:N - key:value to three decimals, keys in order."""
    each = F.concat(F.col("key"), F.lit(":"), F.format_string("%.3f", F.col("value")))
    lines = rows.groupBy("step").agg(F.array_join(F.array_sort(F.collect_list(each)), " - ").alias("rest"))
    return lines.select("step", F.concat(F.lit("step:"), F.col("step").cast("string"), F.lit(" - "), F.col("rest")).alias("line"))
