"""Scores of responses as columns, and a registry of scorers by data source."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import normalize, text
from millrace.functions.symbolic import same_formula
from millrace.operators.losses import kl_shaped

Scorer = Callable[[Column, Column], Column]


def hash_score(response: Column, truth: Column, method: str = "strict", format_score: float = 0.0, score: float = 1.0) -> Column:
    """1 for the right number (after ####, or the last one), the format score for another, 0 for none."""
    got = text.hash_answer(response) if method == "strict" else text.last_number(response)
    return F.when(got.isNull(), 0.0).when(got == truth, score).otherwise(format_score)


def boxed_score(response: Column, truth: Column) -> Column:
    """The last box, its braces balanced at any depth, equal to the truth in plain form; without a box (or with a framed one) 0."""
    content = text.box_content(text.last_box(response))
    return text.let(content, lambda got: F.when(got.isNull(), 0.0).when(normalize.equivalent(got, truth), 1.0).otherwise(0.0))


def format_score(response: Column) -> Column:
    return F.when(F.rlike(response, F.lit(r"(?s)\A<think>.*</think>.*\\boxed\{.*\}.*\z")), 1.0).otherwise(0.0)


def geometry_score(response: Column, truth: Column) -> Column:
    """0.9 for the answer and 0.1 for the format."""
    return 0.9 * F.when(text.last_boxed(response) == truth, 1.0).otherwise(0.0) + 0.1 * format_score(response)


def grades(got: Column, truth: Column) -> Column:
    """struct(early, near): equal plain or lenient forms; equal numbers with pi as its value or as 3.14, where it occurs."""
    value = lambda x, pi: F.coalesce(normalize.pi_value(x, pi), normalize.number_of(x))
    with_pi = F.contains(got, F.lit("\\pi")) | F.contains(truth, F.lit("\\pi"))
    forms = lambda x: F.struct(normalize.plain_answer(x).alias("plain"), normalize.lenient(x).alias("lenient"), *[F.when(with_pi, value(x, pi)).alias(n) for n, pi in (("pi", math.pi), ("short", 3.14))])

    def of(both: Column) -> Column:
        x, y = F.get(both, F.lit(0)), F.get(both, F.lit(1))
        early = F.coalesce(x["plain"] == y["plain"], F.lit(False)) | F.coalesce(x["lenient"] == y["lenient"], F.lit(False))
        by_pi = F.coalesce(normalize.same_number(x["pi"], y["pi"]), F.lit(False)) | F.coalesce(normalize.same_number(x["short"], y["short"]), F.lit(False))
        return F.struct(early.alias("early"), by_pi.alias("near"))

    return text.let(F.transform(F.array(got, truth), forms), of)


def _or_same_formula(right: Column, got: Column, truth: Column, symbolic: Callable[[Column, Column], Column] | None) -> Column:
    """right, or the same formula; strings that are equal are not looked at again."""
    return right if symbolic is None else right | F.coalesce(symbolic(F.when(got != truth, got), truth), F.lit(False))


def _correct(g: Column, got: Column, truth: Column, symbolic: Callable[[Column, Column], Column] | None) -> Column:
    return _or_same_formula(F.when(g["early"] | g["near"], True).otherwise(normalize.math_equal_column(got, truth)), got, truth, symbolic)


def graded(got: Column, truth: Column, symbolic: Callable[[Column, Column], Column] | None = same_formula) -> Column:
    """Equal forms or numbers (grades), or else by the cascade of comparisons, or the same formula by `symbolic`, a function of two
    columns (null: undecided). The default is a Python function, so that this column cannot stand inside a lambda, nor `got` hold
    one; None leaves formulas out."""
    return _correct(grades(got, truth), got, truth, symbolic)


def matched(response: Column, truth: Column) -> Column:
    """struct(correct, format, answer) of the heuristically matched answer, without formulas (with_matched has them). The format is
    that of a response in steps with a box; it counts as kept where plain or lenient forms are equal."""
    form = F.contains(response, F.lit("Step 2:")) & F.contains(response, F.lit("\\box"))
    of = lambda correct, early, got: F.struct(correct.alias("correct"), (form | early).alias("format"), got.alias("answer"))
    unlike = lambda got: text.let(grades(got, truth), lambda g: of(_correct(g, got, truth, None), g["early"], got))
    return text.let(text.reply(response), lambda got: F.when(got == truth, of(F.lit(True), F.lit(True), got)).otherwise(unlike(got)))  # equal strings have equal forms


def with_matched(df: DataFrame, response: str, truth: str, out: str = "matched", symbolic: Callable[[Column, Column], Column] = same_formula) -> DataFrame:
    """df with matched of two columns, formulas too: the answer is worked out first, since a Python function's argument in Spark
    cannot hold a lambda. A column named `out` is replaced."""
    names = {c.lower() for c in df.columns}
    tmp = next(n for n in ("m" + "_" * i for i in range(1, 10**6)) if n not in names)
    d = df.withColumn(tmp, matched(F.col(f"`{response}`"), F.col(f"`{truth}`")))
    m = F.col(tmp)
    correct = F.when(m["correct"], True).otherwise(F.coalesce(symbolic(m["answer"], F.col(f"`{truth}`")), F.lit(False)))
    return d.withColumn(out, F.struct(correct.alias("correct"), m["format"].alias("format"), m["answer"].alias("answer"))).drop(tmp)


def matched_score(response: Column, truth: Column) -> Column:
    """1 if the heuristically matched answer is right, formulas apart."""
    return F.when(matched(response, truth)["correct"], 1.0).otherwise(0.0)


def verified_score(response: Column, truth: Column, kind: str = "default", n: int = 50, most: int = 20, symbolic: Callable[[Column, Column], Column] | None = same_formula) -> Column:
    """0 for repetitions; 1 for the right box; else 0, or -0.5 (0 without a box) for the kind with format. A box is right if it
    equals the truth in any case, in its normal or plain form, or as a formula (`symbolic` as in graded)."""
    from millrace.operators.repetition import repeats

    wrong = 0.0 if kind == "default" else -0.5
    same = lambda got: (F.lower(got) == F.lower(truth)) | (normalize.final_answer(got) == normalize.final_answer(truth)) | normalize.equivalent(got, truth)
    box = text.last_boxed(response)
    right = _or_same_formula(text.let(box, lambda got: F.coalesce(same(got), F.lit(False))), box, truth, symbolic)
    return F.when(repeats(response, n, most), 0.0).when(box.isNull(), 0.0).when(right, 1.0).otherwise(wrong)


def code_format(response: Column) -> Column:
    """A python block with an output block after it."""
    return F.when(F.rlike(response, F.lit(r"(?s)```python.*?```.*```output.*?```")), 1.0).otherwise(0.0)


#: Scorers by data source (fixed names); any other source takes the default.
SCORERS: dict[str, Scorer] = (
    {"openai/gsm8k": hash_score}
    | dict.fromkeys(["lighteval/MATH", "DigitalLearningGmbH/MATH-lighteval"], boxed_score)
    | dict.fromkeys(["numina_aops_forum", "numina_synthetic_math", "numina_amc_aime", "numina_synthetic_amc", "numina_cn_k12", "numina_olympiads"], matched_score)
    | {"hiyouga/geometry3k": geometry_score}
)


def register(source: str, scorer: Scorer, overwrite: bool = False) -> None:
    if source in SCORERS and not overwrite:
        raise ValueError(f"{source} has a scorer")
    SCORERS[source] = scorer


def dispatched(source: Column, response: Column, truth: Column, default: Scorer = verified_score, scorers: dict[str, Scorer] | None = None) -> Column:
    out = default(response, truth)
    groups: dict[Scorer, list[str]] = {}
    for s, f in (SCORERS if scorers is None else scorers).items():
        groups.setdefault(f, []).append(s)
    for f, names in groups.items():
        out = F.when(source.isin(*names), f(response, truth)).otherwise(out)
    return out


def safe(score: Callable[[str, str], float], seconds: float | None = None) -> Scorer:
    """A scorer from any Python function; what raises, gives no number or takes longer than the limit of a row scores 0."""

    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        from millrace.operators.repetition import time_limit

        def one(x: str, y: str) -> float:
            try:
                with time_limit(seconds):
                    got = score(x, y)
                return float(got[0] if isinstance(got, tuple) else got)
            except Exception:  # a scorer's own error is a score of 0
                return 0.0

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    return run


def code_share(tests: DataFrame, solution: str, test: str, passed: str, first: int = 10) -> DataFrame:
    """solution and score: 1 if all tests pass, else the share of its first tests that do. Results are given; nothing is run."""
    ok = F.col(passed).cast("double")
    g = tests.groupBy(solution).agg(F.min(ok).alias("all"), F.avg(F.when(F.col(test) < first, ok)).alias("share"))
    return g.select(solution, F.when(F.col("all") == 1, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))


def output_matches(output: Column, expected: Column) -> Column:
    """Outputs compared: trimmed, line by line without blank lines, as numbers, as sets of tokens."""
    lines = lambda c: F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    parts = lambda c: F.filter(F.split(c, r"\s+"), lambda x: x != "")


    def alike(both: Column) -> Column:
        a, b = both["a"], both["b"]
        number = lambda p, n: p[n].try_cast("double")  # noqa: E731 # read one by one, up to the first pair that differs
        near = (F.size(a) == F.size(b)) & (F.size(a) > 0) & F.forall(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: F.coalesce(F.abs(number(p, "x") - number(p, "y")) <= 1e-8 + 1e-5 * F.abs(number(p, "y")), F.lit(False)))
        return near | (F.sort_array(F.array_distinct(a)) == F.sort_array(F.array_distinct(b)))

    return (F.trim(output) == F.trim(expected)) | (lines(output) == lines(expected)) | text.let(F.struct(parts(output).alias("a"), parts(expected).alias("b")), alike)


#: Results of a run against an expected output: right, wrong, an error while running, an error before that.
RIGHT, WRONG, RUN_ERROR, COMPILE_ERROR = 1, 0, -1, -2


def output_result(output: Column, expected: Column, error: Column) -> Column:
    """The code of a run's result. error: run, compile, or null."""
    return F.when(error == "compile", COMPILE_ERROR).when(error == "run", RUN_ERROR).when(output_matches(output, expected), RIGHT).otherwise(WRONG)


def sparse_reward(score: Column, valid: Column, length: Column, given: Column | None = None, passes: Column | None = None, optimised: Column | None = None) -> Column:
    """An array of zeros with the score at the last valid position; rows of pass-rate optimisation have their passes there instead.
    Rewards that are given (not null) are returned as they are."""
    if optimised is not None:
        score = F.when(optimised == 1, passes.cast("double")).otherwise(score)
    made = F.when(length > 0, F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.when(i == valid - 1, score).otherwise(F.lit(0.0)))).otherwise(F.array().cast("array<double>"))
    return made if given is None else F.coalesce(given, made)


def at_last_position(score: Column, positions: Column, mask: Column, response_length: Column) -> Column:
    """A model's score at the attended position of the largest position id (the first of them), response part only."""
    masked = F.zip_with(positions, mask, lambda p, m: p * m)
    at = F.array_position(masked, F.array_max(masked)) - 1
    return F.slice(F.transform(positions, lambda _, i: F.when(i == at, score).otherwise(F.lit(0.0))), F.size(positions) - response_length + 1, response_length)


def kl_rewards(df: DataFrame, score: str, new: str, reference: str, mask: str, beta: float, kind: str = "kl", out: str = "reward") -> DataFrame:
    """Token rows with score - beta * divergence (masked)."""
    return df.withColumn(out, kl_shaped(F.col(score), F.col(new) * F.col(mask), F.col(reference) * F.col(mask), beta, kind))


def classified(return_code: Column, stdout: Column, stderr: Column) -> Column:
    """struct(output, status) of a run: Done with output, else the error output; without a code Error, UnknownError."""
    done = (return_code == 0) & (stdout != "")
    return F.when(return_code.isNull(), F.struct(F.lit("Error").alias("output"), F.lit("UnknownError").alias("status"))).when(done, F.struct(stdout.alias("output"), F.lit("Done").alias("status"))).otherwise(F.struct(F.lit("").alias("output"), stderr.alias("status")))


def observation(output: Column, status: Column) -> Column:
    """struct(text, passed) that follows a tool call: output if it is done, else the status; of errors the last line, nothing as
    a time-out; 256 characters or more shortened to both ends."""
    raw = F.when(status == "Done", output).otherwise(status)
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    line = text.let(trim(raw), lambda c: F.when(F.contains(raw, F.lit("Error")), F.element_at(F.split(c, "\n"), -1)).otherwise(raw))
    filled = text.let(trim(line), lambda c: F.when(F.length(c) == 0, "timeout_decorator.TimeoutError: 'Timed Out'").otherwise(c))
    short = text.let(filled, lambda c: F.when(F.length(c) >= 256, F.concat(F.left(c, F.lit(128)), F.lit("..."), F.right(c, F.lit(128)))).otherwise(c))
    return F.struct(F.concat(F.lit("\n```output\n"), short, F.lit("\n```\n")).alias("text"), F.when(status == "Done", 1).otherwise(0).alias("passed"))


def pass_fraction(passes: Column) -> Column:
    """The mean of 0/1 results as a whole number: 1 only if all passed; 1 without results."""
    n = F.size(passes)
    return F.when(n > 0, F.floor(F.aggregate(passes, F.lit(0.0), lambda s, x: s + x) / F.when(n > 0, n))).otherwise(1).cast("long")
