"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Timestamps are TIMESTAMP_NTZ and mean UTC, so the session zone must be UTC too.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app: str = "queuetide", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **extra}.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> None:
    """For sessions built elsewhere: timestamps without a zone are read as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Set ``spark.cleaner.referenceTracking.cleanCheckpoints`` to have checkpoints deleted
    with the frames they belong to.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        raise ValueError("spark.checkpoint.dir names no shared folder; intermediates need one that all executors reach")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def name_shared_dir(spark: SparkSession) -> None:
    """For sessions that name no shared folder: one below the warehouse, which executors share."""
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        spark.conf.set("spark.checkpoint.dir", spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpoint(df):
    """Cut the lineage through the shared folder, so a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def materialise(df, label: str = "step"):
    """``df`` written once to the shared folder and read back.

    For results that several parts of a plan use: the input behind them is read
    once, a lost executor costs nothing, and later joins know the real size.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What a query in the block shuffled is deleted when the query ends, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder whose content is stored elsewhere by now."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def input_bytes(df: DataFrame) -> int:
    """The size of the files that ``df`` is read from; none of them is opened."""
    files = [unquote(f) for f in df.inputFiles()]
    return df.sparkSession.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0] if files else 0
