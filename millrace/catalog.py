"""Named queries over the test tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import advantage, groups
from millrace.plans import fixtures, rows, texts, tokens  # noqa: F401  each registers its queries


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Trajectories of groups whose rewards vary, with their group-relative advantages."""
    kept = groups.group_variance(fixtures.trajectories(spark, sf), "uid", "reward")
    return advantage.group_relative(kept, "uid", "reward").select("row_id", "uid", "reward", F.round("advantage", 6).alias("advantage"))


FLAGSHIP_SQL = f"""WITH {fixtures.TRAJ}, g AS (SELECT *, count(*) OVER w AS n, avg(reward) OVER w AS mu, stddev_samp(reward) OVER w AS sd, stddev_pop(reward) OVER w AS sp FROM traj WINDOW w AS (PARTITION BY uid))
SELECT row_id, uid, reward, round((reward - CASE WHEN n = 1 THEN 0 ELSE mu END) / (CASE WHEN n = 1 THEN 1 ELSE sd END + 1e-6), 6) AS advantage FROM g WHERE sp > 0 OR n = 1"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"flagship": flagship} | fixtures.QUERIES


def oracle_sql() -> dict[str, str]:
    return {"flagship": FLAGSHIP_SQL} | fixtures.SQL
