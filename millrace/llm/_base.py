"""What the operators of this subpackage share: tables, the cluster's shared folder, written intermediate tables."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where that is unset, a new one of this machine if
    Spark runs in this process alone (tests); on a cluster this raises."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_millrace_dir", None)
    if not where:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = sc._millrace_dir = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return where.rstrip("/")


class Workspace:
    """Intermediate tables, written once as Parquet in the shared folder, so that a lost executor loses none and no stage is
    computed twice. They go when the application ends; what is returned may be read until then."""

    def __init__(self, spark: SparkSession, name: str, basis: DataFrame | None = None):
        """basis: the table that the others are made from; by its size they get no more files than it would need."""
        self.spark, self.path, self.basis = spark, f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}", basis
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.mkdirs(folder):
            fs.deleteOnExit(folder)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        if self.basis is not None:
            df = few_files(df, self.basis)
        df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{self.path}/{name}")  # read only after it is committed
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for n in names:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}")
            p.getFileSystem(conf).delete(p, True)


def few_files(df: DataFrame, basis: DataFrame) -> DataFrame:
    """df in at most four partitions a core, or one for each 32 MB of basis if those are more: no thousands of tiny files."""
    size = int(basis._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    most = max(4 * df.sparkSession.sparkContext.defaultParallelism, size >> 25)
    return df.coalesce(most) if most < 1 << 30 else df  # a size that Spark cannot tell counts as huge


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names of our own that no column of df has in any case."""
    taken = {c.lower() for c in df.columns}
    return [next(n for n in (x + "_" * i for i in range(2, 10**6)) if n.lower() not in taken) for x in names]


def rows_of(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under names of our own: whatever else the input has cannot clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow, with Arrow batches of a few MB: the session's limit is lowered where it is Spark's own (64 MB), since JVM
    and Python each hold a batch for every task."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864b", "67108864", "64MB"):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4MB")
    return df.mapInArrow(run, schema)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of a string column, and `rows` rows at most (one row at least)."""
    for batch in batches:
        n = pc.binary_length(batch.column(column).cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, x in enumerate(n.tolist()):
            if i > start and (held + x > most or i - start == rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += x
        if start < batch.num_rows:
            yield batch.slice(start)
    give_back()


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null as empty, stray bytes as U+FFFD."""
    out = []
    for raw in column.cast(pa.large_binary()).to_pylist():
        try:
            (raw or b"").decode()
        except UnicodeDecodeError:
            raw = raw.decode("utf-8", "replace").encode()
        out.append(raw or b"")
    return out


def give_back() -> None:
    """At a task's end: memory that the allocators hold goes back to the system, since Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def one_thread() -> None:
    """Executors have as many tasks as cores: the tokenizers library starts no threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
