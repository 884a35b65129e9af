"""Roles that the test tables play, as DataFrames and as SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources.tables import dealt, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(x: Column, places: int) -> Column:
    """Rounded half away from zero as the SQL does, on the double itself: the sign of a zero stays, ties are those of the binary value."""
    f = 10.0**places
    return F.signum(x) * F.floor(F.abs(x) * f + 0.5).cast("double") / f


TOKEN_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

#: Trajectories: an order; its customer is the prompt.
TRAJ = "traj AS (SELECT o_orderkey AS row_id, o_custkey AS uid, CASE WHEN o_orderstatus = 'F' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS reward, o_totalprice AS score, o_orderpriority AS source FROM orders)"
#: Tokens of a trajectory: its line items in a total order.
TOK = f"tok AS (SELECT l_orderkey AS row_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(TOKEN_ORDER)}) - 1 AS t, l_tax AS v, l_discount AS r, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS m, CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END AS tool, l_partkey AS id FROM lineitem)"
#: Token arrays of a trajectory.
SEQ = TOK + ", seq AS (SELECT row_id, list(v ORDER BY t) AS vs, list(r ORDER BY t) AS rs, list(m ORDER BY t) AS ms, list(tool ORDER BY t) AS tools, list(id ORDER BY t) AS ids FROM tok GROUP BY row_id)"
#: Responses: texts made of an order's number.
RESPONSE = """concat(CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '<think>' END, 'try ', repeat(concat('x', o_orderkey % 97, ' '), CAST(o_orderkey % 40 AS INT)),
 '```python', chr(10), repeat(concat('print(', o_orderkey % 10, ')', chr(10)), CAST(o_orderkey % 9 AS INT)), '```', CASE WHEN o_orderkey % 4 = 0 THEN concat(chr(10), '```output', chr(10), o_orderkey % 10, chr(10), '```') ELSE '' END,
 ' costs ', CASE WHEN o_orderkey % 7 = 0 THEN '$1 $2 $' WHEN o_orderkey % 7 = 1 THEN concat(chr(92), '$5 $') ELSE '$a$' END, '</think>', 'answer is ', chr(92), 'boxed{', CASE WHEN o_orderkey % 6 = 0 THEN concat(chr(92), 'frac{1}{', o_orderkey % 50, '}') ELSE concat('', o_orderkey % 50) END, '}',
 CASE WHEN o_orderkey % 8 = 0 THEN concat(' #### 1,', o_orderkey % 900 + 100) ELSE '' END, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '<|im_end|>' END)"""
RESP = f"resp AS (SELECT o_orderkey AS row_id, o_custkey AS uid, o_orderpriority AS source, {RESPONSE} AS predict, concat('', o_orderkey % 50) AS truth, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS score, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE 1 END AS passes FROM orders)"


def trajectories(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("uid"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("reward"), F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("source"))


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").withColumn("t", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*TOKEN_ORDER)) - 1)
    return x.select(
        F.col("l_orderkey").alias("row_id"), "t", F.col("l_tax").alias("v"), F.col("l_discount").alias("r"), F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("m"), F.when(F.col("l_returnflag") == "A", 0).otherwise(1).alias("tool"), F.col("l_partkey").alias("id")
    )


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Token arrays in order: one shuffle by trajectory, no window."""
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.struct(*TOKEN_ORDER).alias("k"))
    g = x.groupBy("row_id").agg(F.array_sort(F.collect_list("k")).alias("k"))
    pick = lambda f: F.transform("k", f)
    return g.select(
        "row_id", pick(lambda x: x["l_tax"]).alias("vs"), pick(lambda x: x["l_discount"]).alias("rs"), pick(lambda x: F.when(x["l_linestatus"] == "O", 1).otherwise(0)).alias("ms"), pick(lambda x: F.when(x["l_returnflag"] == "A", 0).otherwise(1)).alias("tools"), pick(lambda x: x["l_partkey"]).alias("ids")
    )


def responses(spark: SparkSession, sf: str, costly: bool = False) -> DataFrame:
    """costly: orders are dealt over the cluster before the texts are made."""
    o = table(spark, sf, "orders")
    if costly:
        o = dealt(o.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"))
    k = F.col("o_orderkey")
    return o.select(k.alias("row_id"), F.col("o_custkey").alias("uid"), F.col("o_orderpriority").alias("source"), F.expr(RESPONSE).alias("predict"), F.concat(F.lit(""), k % 50).alias("truth"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("score"), F.when(k % 11 == 0, 0).otherwise(1).alias("passes"))
