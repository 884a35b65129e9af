"""Groups carried over batches until enough are there: over a table of batches by pointer doubling, and over a stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.sequence import packed_offsets
from millrace.operators.batch import numbered
from millrace.sources.tables import materialized, shared_folder, until_exit

MARK = "batch long, since long"


#: Batches of a bucket, in which segments and batches meet.
BUCKET = 256


def carried(batches: DataFrame, order: str, groups: str, enough: int) -> DataFrame:
    """order, carried (groups kept after the batch comes in) and emitted: at `enough` or more all are emitted and the count
    starts anew. Batches are in the order of `order`, which must be total; groups are whole numbers from 0 on (null: 0).

    No task sees all batches. Running sums tell of every batch where an emission would come next, if the count started there; these
    pointers are followed from the first batch by doubling: each round joins them with themselves, so that as many rounds as
    the number of emissions has binary digits find all starts.
    """
    rows = numbered(batches.select(F.col(order).alias("o"), F.coalesce(F.col(groups), F.lit(0)).cast("long").alias("n")), "o", row="i")
    m = rows.count()
    if not m:
        return rows.select(F.col("o").alias(order), F.col("n").alias("carried"), F.lit(False).alias("emitted"))
    sums = materialized(packed_offsets(rows, "n", "i").withColumnRenamed("cu_seqlen", "before"), "sums")
    wanted = sums.where(F.col("i") < m).select((F.col("before") + enough).alias("v"), F.lit(0).alias("kind"), "i")
    reached = sums.where(F.col("i") > 0).select(F.col("before").alias("v"), F.lit(1).alias("kind"), (F.col("i") - 1).alias("i"))
    # among sums in order, what lies before the i-th wanted one is i wanted ones and the sums that are too small
    at = numbered(wanted.unionByName(reached), "v", "kind", "i", row="at").where("kind = 0").select("i", F.greatest("i", F.col("at") - F.col("i")).alias("j"))
    first = materialized(at.where(F.col("j") < m).select("i", (F.col("j") + 1).alias("to")), "jumps")
    starts, jumps = rows.where("i = 0").select("i"), first
    while not jumps.isEmpty():
        starts = materialized(starts.unionByName(starts.join(jumps, "i").where(F.col("to") < m).select(F.col("to").alias("i"))), "starts")
        jumps = materialized(jumps.select("i", F.col("to").alias("via")).join(jumps.select(F.col("i").alias("via"), "to"), "via").select("i", "to"), "jumps")
    segments = starts.join(first, "i", "left").join(sums, "i").select(F.col("i").alias("s"), F.coalesce("to", F.lit(m)).alias("to"), F.col("to").isNotNull().alias("emits"), F.col("before").alias("base"))
    bucket = lambda c: F.floor(c / BUCKET)
    dealt = segments.withColumn("b", F.explode(F.sequence(bucket(F.col("s")), bucket(F.col("to") - 1))))
    each = rows.join(sums, "i").select("o", "i", (F.col("before") + F.col("n")).alias("through"), bucket(F.col("i")).alias("b"))
    met = each.join(dealt, "b").where("s <= i AND i < to")
    return met.select(F.col("o").alias(order), (F.col("through") - F.col("base")).alias("carried"), (F.col("emits") & (F.col("i") == F.col("to") - 1)).alias("emitted"))


class CarryOver:
    """A foreachBatch sink: rows of groups wait in a folder until `enough` distinct groups are there, then go to `emit`.

    Each batch's rows are written once, under its id; a table of marks says from which batch on rows wait. With a path (beside
    the stream's checkpoint) another process goes on where this one ended. A batch that is given twice is left out; one whose
    emission was not marked before a failure is emitted again.
    """

    def __init__(self, group: str, enough: int, emit: Callable[[DataFrame, int], None], path: str | None = None):
        self.group, self.enough, self.emit, self.path = group, enough, emit, path
        self.last, self.since = -1, None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if self.path is None:
            self.path = until_exit(spark, f"{shared_folder(spark)}/carry-{uuid.uuid4().hex}")
        if self.since is None:
            self.last, self.since = self.marked(spark)
        if batch_id <= self.last:
            return
        batch.write.mode("overwrite").parquet(f"{self.path}/rows/{batch_id}")
        waiting = [i for i in self.written(spark) if self.since <= i <= batch_id]
        held = spark.read.schema(batch.schema).parquet(*[f"{self.path}/rows/{i}" for i in waiting])
        since = self.since
        if held.agg(F.countDistinct(self.group)).first()[0] >= self.enough:
            self.emit(held, batch_id)
            since = batch_id + 1
        spark.createDataFrame([(batch_id, since)], MARK).coalesce(1).write.mode("append").parquet(f"{self.path}/marks")
        self.last, self.since = batch_id, since

    def written(self, spark: SparkSession) -> list[int]:
        """Ids of the batches whose rows are there."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows")
        return sorted(int(x.getPath().getName()) for x in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder))

    def marked(self, spark: SparkSession) -> tuple[int, int]:
        """The last batch that was taken, and the first whose rows wait."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/marks")
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return -1, 0
        return tuple(spark.read.schema(MARK).parquet(f"{self.path}/marks").agg(F.max(F.struct("batch", "since")).alias("x")).select("x.*").first())


def windowed_means(stream: DataFrame, time: str, key: str, value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Means by key and window of a stream or a table, late rows within the watermark included. An extension for metric streams."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
