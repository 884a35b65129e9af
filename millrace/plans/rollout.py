"""The multi-round tool loop over given generations and results: nothing is generated or run here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.functions.scan import scanned
from millrace.operators.scores import classified, observation
from millrace.sources.tables import materialized

#: Rows that one task joins and puts together, about; a task's memory does not grow with the table.
ROWS = 1 << 15


def tool_loop(prompts: DataFrame, generate: Callable[[DataFrame, int], DataFrame], execute: Callable[[DataFrame, int], DataFrame], rounds: int, stop_on_failure: bool = True, budget: int | None = None) -> DataFrame:
    """row_id, response, stop, passes (0/1 of each call) and ranges (characters of tool output) after at most `rounds` rounds.

    generate(active rows, round) gives row_id and output; execute(rows with code, round) gives row_id, return_code, stdout,
    stderr. A round appends the output, and the observation if it calls a tool; a row without a call, or with a failed one
    if stop_on_failure, is done; so is a row for which nothing is generated. The budget counts rounds with a call.

    The rounds are a log: each writes what it appends to its active rows to the shared folder, once. generate sees the active rows
    with their responses so far, of the log's entries for these rows alone; finished rows are not touched again until one ordered
    aggregate puts all responses together at the end. All of it is dealt by row_id over a partition for each ROWS rows, where those
    are more than the cores: partitions that Spark merges by their compressed size may be many times that in memory.
    """
    rows = prompts.select(F.col("row_id").cast("long").alias("row_id"))
    parts = rows.count() // ROWS
    many = parts > rows.sparkSession.sparkContext.defaultParallelism  # fewer than that Spark does not merge partitions to
    dealt = lambda df: df.repartition(parts, "row_id") if many else df
    rows = dealt(rows)
    log: list[DataFrame] = []
    active, left = rows.withColumn("response", F.lit("")), rounds if budget is None else budget
    for k in range(rounds):
        if left <= 0 or active.isEmpty():
            break
        out = active.select("row_id").join(generate(active, k).select("row_id", "output"), "row_id").withColumn("code", text.last_program(F.col("output")))
        out = dealt(materialized(out, "round"))
        calls = out.where("code <> ''")
        left -= not calls.isEmpty()
        ran = execute(calls.select("row_id", "code"), k)
        c = classified(F.col("return_code"), F.col("stdout"), F.col("stderr"))
        seen = ran.select("row_id", c.alias("c")).select("row_id", observation(F.col("c.output"), F.col("c.status")).alias("o"))
        done = F.col("o").isNull() | ((F.col("o.passed") == 0) & F.lit(stop_on_failure))
        silent = active.join(out.select("row_id"), "row_id", "left_anti").select("row_id", F.lit(None).cast("string").alias("output"), F.lit(None).cast("string").alias("seen"), F.lit(None).cast("int").alias("passed"), F.lit(True).alias("stop"))
        step = out.join(seen, "row_id", "left").select("row_id", "output", F.col("o.text").alias("seen"), F.col("o.passed").alias("passed"), done.alias("stop")).unionByName(silent)
        log.append(materialized(step.withColumn("round", F.lit(k)), "delta"))
        going = log[-1].where("NOT stop").select("row_id")
        active = _responses(going, log, dealt)
    return _assembled(rows, log, dealt)


def _entries(log: list[DataFrame]) -> DataFrame | None:
    out = None
    for x in log:
        out = x if out is None else out.unionByName(x)
    return out


def _responses(rows: DataFrame, log: list[DataFrame], dealt: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """row_id and response so far of some rows: the log's entries for them, in order of rounds."""
    entry = F.struct("round", F.concat(F.coalesce("output", F.lit("")), F.coalesce("seen", F.lit(""))).alias("t"))
    parts = dealt(_entries(log)).join(rows, "row_id", "left_semi").groupBy("row_id").agg(F.array_sort(F.collect_list(entry)).alias("x"))
    return parts.select("row_id", F.array_join(F.transform("x", lambda e: e["t"]), "").alias("response"))


def _assembled(rows: DataFrame, log: list[DataFrame], dealt: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All rows with what the log holds of them: at most one entry a round and row in one array."""
    if not log:
        return rows.select("row_id", F.lit("").alias("response"), F.lit(False).alias("stop"), F.array().cast("array<int>").alias("passes"), F.array().cast("array<struct<s:int,e:int>>").alias("ranges"))
    entry = F.struct("round", "output", "seen", "passed", "stop")
    whole = rows.join(dealt(_entries(log)).groupBy("row_id").agg(F.array_sort(F.collect_list(entry)).alias("x")), "row_id", "left")
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    start = F.struct(F.lit(0).alias("end"), F.lit(None).cast("struct<s:int,e:int>").alias("spot"))

    def step(a: Column, e: Column) -> Column:
        body = a["end"] + size(e["output"])
        end = body + size(e["seen"])
        return F.struct(end.alias("end"), F.when(e["passed"].isNotNull(), F.struct(body.alias("s"), end.alias("e"))).alias("spot"))

    there = F.coalesce(F.col("x"), F.array().cast(whole.schema["x"].dataType))
    return whole.select(
        "row_id",
        F.array_join(F.transform(there, lambda e: F.concat(F.coalesce(e["output"], F.lit("")), F.coalesce(e["seen"], F.lit("")))), "").alias("response"),
        F.exists(there, lambda e: e["stop"]).alias("stop"),
        F.filter(F.transform(there, lambda e: e["passed"]), lambda p: p.isNotNull()).alias("passes"),
        F.filter(scanned(there, start, step, lambda s: s["spot"], "struct<s:int,e:int>"), lambda p: p.isNotNull()).alias("ranges"),
    )


def with_early_stop(df: DataFrame, budget: int, note: str, tokens: str = "n_tokens") -> DataFrame:
    """Responses over a thinking budget get a closing note and the tokens that are left: column left."""
    over = F.col(tokens) >= budget
    return df.withColumn("left", F.greatest(F.lit(0), F.lit(budget) - F.col(tokens))).withColumn("response", F.when(over, F.concat("response", F.lit(note))).otherwise(F.col("response")))


def retries(df: DataFrame, failed: str, times: int, drop: int) -> DataFrame:
    """For each failed row `times` attempts, their tokens cut back by `drop` a time more each: row, attempt, tokens."""
    return df.where(failed).withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn("tokens", F.slice("tokens", F.lit(1), F.greatest(F.lit(0), F.size("tokens") - F.col("attempt") * drop)))


def regenerated(df: DataFrame, passed: str, times: int) -> DataFrame:
    """Failed rows cut before their last call, `times` each, appended to all rows with the flag pass_optim 1."""
    extra = df.where(F.col(passed) == 0).withColumn("response", text.without_last_call(F.col("response"))).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn("pass_optim", F.lit(1))
    return df.withColumn("copy", F.lit(0)).withColumn("pass_optim", F.lit(0)).unionByName(extra)


def tries(queries: DataFrame, times: int) -> DataFrame:
    """Every query `times` times, with try_id."""
    return queries.withColumn("try_id", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
