"""Stored rows fed to a stream again in stated batches, late rows and restarts included.

Rows get the number of the batch they arrive in; each batch is one folder with one file.
Folders are numbered and written one after another, so that a file source, which goes by
modification time and then by path, takes them in order on any store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import TS
from ..functions.calendar import micros
from ..session import materialise, scratch_path


def arrivals(df: DataFrame, n: int, ts: str = TS, behind: Column | None = None) -> DataFrame:
    """``df`` with ``batch``: the time from first to last row cut into ``n`` equal spans, plus ``behind`` batches."""
    us = micros(ts)
    low, high = df.agg(F.min(us), F.max(us)).first()
    if low is None:
        return df.withColumn("batch", F.lit(0))
    base = F.expr(f"(cast(unix_micros(cast({ts} as timestamp)) as bigint) - {low}L) * {n} div {high - low + 1}L")
    late = F.lit(0) if behind is None else behind
    return df.withColumn("batch", F.least(F.lit(n - 1), (base + late).cast("int")))


class Replay:
    """``n`` batches of ``rows`` (with ``batch``) and the stream that reads those fed so far."""

    def __init__(self, rows: DataFrame, n: int, label: str = "replay"):
        self.spark, self.n, self.fed = rows.sparkSession, n, 0
        self.rows = materialise(rows, f"{label}-rows")
        self.path = scratch_path(self.spark, label)
        self.schema = rows.drop("batch").schema

    def feed(self, until: int) -> None:
        """Write the batches up to ``until``; one without rows is a file without rows."""
        for k in range(self.fed, until):
            self.rows.where(F.col("batch") == k).drop("batch").coalesce(1).write.parquet(f"{self.path}/b{k:05d}")
        self.fed = max(self.fed, until)

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/b*")

    def run(self, start: Callable[[], object], checkpoint_path: str, restart_at: int) -> None:
        """Run to the end of the input in two queries: the second goes on from the first one's checkpoint.

        ``start`` starts a query on :meth:`stream` that ends when it has read all there is.
        """
        for until in (restart_at, self.n):
            self.feed(until)
            start().awaitTermination()
        done = committed_batches(self.spark, checkpoint_path)
        if done < self.n:
            raise RuntimeError(f"{done} micro-batches ran, {self.n} were fed")


def committed_batches(spark: SparkSession, checkpoint_path: str) -> int:
    """Micro-batches, those without data included, that a checkpoint holds as done."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_path}/commits")
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sum(f.getPath().getName().isdigit() for f in listed)
