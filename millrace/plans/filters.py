"""Filter chains: every predicate in one projection, and the first stage that a row fails as its reason."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators.repetition import repeats

Stage = tuple[str, Column]


def reasons(stages: list[Stage]) -> Column:
    """The name of the first stage that does not hold (null counts as failed), or null."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(stages):
        out = F.when(F.coalesce(holds, F.lit(False)), out).otherwise(F.lit(name))
    return out


def multistage(predict: str = "predict", score: str = "score", passes: str = "passes", least: int = 3000, n: int = 20, most: int = 20, traditional: str = "", repetition: Callable[[Column], Column] | None = None) -> list[Stage]:
    """Right, every call passed, long enough, boxed, dollars paired, no traditional characters, think block, answer tail, no
    repetition: cheap stages first."""
    p = F.col(predict)
    repeated = (repetition or (lambda c: repeats(c, n, most)))(p)
    return [
        ("score", F.col(score) == 1),
        ("passes", F.col(passes) == 1),
        ("length", F.length(p) >= least),
        ("boxed", ~text.no_boxed(p)),
        ("dollars", ~text.unpaired_dollars(p)),
        ("traditional", ~text.has_any_of(p, traditional) if traditional else F.lit(True)),
        ("think", text.think_block(p)["ok"]),
        ("answer", text.answer_tail(p)),
        ("repetition", ~repeated),
    ]


def acceptance(predict: str = "predict", score: str = "score", passes: str = "passes", n: int = 50, most: int = 30, repetition: Callable[[Column], Column] | None = None) -> list[Stage]:
    """The sampler's shorter chain; its think stage asks for code of any quality."""
    p = F.col(predict)
    repeated = (repetition or (lambda c: repeats(c, n, most)))(p)
    return [("score", F.col(score) == 1), ("passes", F.col(passes) == 1), ("think", text.think_block(p, quality=False)["ok"]), ("answer", text.answer_tail(p)), ("repetition", ~repeated)]


def with_reason(df: DataFrame, stages: list[Stage]) -> DataFrame:
    return df.withColumn("reason", reasons(stages))


def kept(df: DataFrame, stages: list[Stage], predict: str = "predict") -> DataFrame:
    """Rows that pass all stages, with the number of code blocks of their think part."""
    return with_reason(df, stages).where("reason IS NULL").drop("reason").withColumn("code_num", text.think_block(F.col(predict))["code_num"])


def prompts_within(df: DataFrame, length: Column, most: int, template: str = "default") -> DataFrame:
    """Prompts of at most `most` tokens, ten fewer for templates other than the default."""
    return df.where(length <= (most if template == "default" else most - 10))
