"""Tables of a folder, and intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder of Parquet files; filters and column choices are pushed into its scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(df: DataFrame, least: int = 1 << 14, most: int = 1 << 22) -> DataFrame:
    """df dealt over the cluster, for costly work on each row: four partitions a core, though none for less than `least` bytes of
    the files read, and one for each `most` bytes if those are more. A scan alone has a partition for each 4 MB at best, and no
    more than there are row groups."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n = max(min(4 * df.sparkSession.sparkContext.defaultParallelism, size // least), min(size // most, 1 << 14))
    return df.repartition(n) if n > 1 else df


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where that is unset, a folder of this machine if Spark runs in this process alone (as
    in tests); on a cluster this raises."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_millrace_tables", None)
    if not where:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = sc._millrace_tables = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return where.rstrip("/")


def until_exit(spark: SparkSession, path: str) -> str:
    """The path of a new folder, which goes when the application ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.mkdirs(folder):
        fs.deleteOnExit(folder)
    return path


def materialized(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: cuts the lineage of loops, and outlives executors. It goes when
    the application ends."""
    path = until_exit(df.sparkSession, f"{shared_folder(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}") + "/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
