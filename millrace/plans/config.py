"""Checks of a training configuration before any data is read."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def problems(config: Mapping[str, int | None | str | bool]) -> list[str]:
    """What is wrong with batch sizes and options, in words; empty if nothing is.

    train_batch and samples: prompts of a step and responses of each; ranks: data-parallel workers; mini: rows of an update;
    micro and micro_per_rank: two names of one setting, of which exactly one is given unless dynamic; estimator and critic.
    """
    out = []
    rows, ranks = (config.get("train_batch") or 0) * (config.get("samples") or 1), config.get("ranks") or 1
    if rows <= 0 or rows % ranks:
        out.append("train_batch * samples is not divisible by the ranks")
    mini = config.get("mini") or rows
    if mini > rows:
        out.append("mini is larger than the batch")
    micro, per_rank = config.get("micro"), config.get("micro_per_rank")
    if not config.get("dynamic"):
        if micro is None and per_rank is None:
            out.append("one of micro and micro_per_rank is needed")
        if micro is not None and per_rank is not None:
            out.append("micro and micro_per_rank exclude each other")
        if micro and mini % micro:
            out.append("mini is not divisible by micro")
        if micro and micro % ranks:
            out.append("micro is not divisible by the ranks")
    if config.get("estimator") in ("gae", "decoupled_gae") and not config.get("critic", True):
        out.append("the estimator needs a critic")
    return out


def checked(configs: DataFrame, out: str = "problems") -> DataFrame:
    """A table of configurations, one a row, with `problems` of each in an array column. Columns as the settings' names; what is not
    there counts as not set. A column named `out` is replaced."""
    names = {c.lower() for c in configs.columns}
    get = lambda n, kind="long": F.col(n).cast(kind) if n in names else F.lit(None).cast(kind)
    set_ = lambda c, other: F.when(F.coalesce(c, F.lit(0)) != 0, c).otherwise(other)
    rows, ranks = F.coalesce(get("train_batch"), F.lit(0)) * set_(get("samples"), F.lit(1)), set_(get("ranks"), F.lit(1))
    mini, micro, per_rank = set_(get("mini"), rows), get("micro"), get("micro_per_rank")
    fixed, odd = ~F.coalesce(get("dynamic", "boolean"), F.lit(False)), lambda a, b: set_(micro, F.lit(None)).isNotNull() & (a % set_(b, F.lit(1)) != 0)
    rules = [
        ("train_batch * samples is not divisible by the ranks", (rows <= 0) | (rows % ranks != 0)),
        ("mini is larger than the batch", mini > rows),
        ("one of micro and micro_per_rank is needed", fixed & micro.isNull() & per_rank.isNull()),
        ("micro and micro_per_rank exclude each other", fixed & micro.isNotNull() & per_rank.isNotNull()),
        ("mini is not divisible by micro", fixed & odd(mini, micro)),
        ("micro is not divisible by the ranks", fixed & odd(micro, ranks)),
        ("the estimator needs a critic", F.coalesce(get("estimator", "string").isin("gae", "decoupled_gae"), F.lit(False)) & ~F.coalesce(get("critic", "boolean"), F.lit(True))),
    ]
    return configs.withColumn(out, F.filter(F.array(*[F.when(wrong, text) for text, wrong in rules]), lambda p: p.isNotNull()))


def validate(config: Mapping[str, int | None | str | bool]) -> None:
    if found := problems(config):
        raise ValueError("; ".join(found))
