"""Versioned forecast snapshots: readers see the newest complete one.

Each attempt of a run writes to a folder of its own; a manifest row that names the
folder, written last, makes the run visible. Whatever fails before that leaves the
visible runs as they are, also when it is another attempt of one of them.

Old runs and failed attempts go by :func:`expire`, but for runs that a reader has leased.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import as_ts
from .writers import _exists, _files, _text

MANIFEST = "run_id bigint, generated_at timestamp_ntz, rows bigint, folder string"


def publish_forecast(forecast: DataFrame, path: str, run_id: int, generated_at) -> int:
    """Write one run and then its manifest row; returns the number of rows.

    A run that is visible already is refused.
    """
    spark = forecast.sparkSession
    if not manifest(spark, path).where(F.col("run_id") == run_id).isEmpty():
        raise ValueError(f"run {run_id} is published already")
    folder = f"data/run_id={run_id}/attempt-{uuid.uuid4().hex}"
    forecast.write.parquet(f"{path}/{folder}")
    rows = spark.read.parquet(f"{path}/{folder}").count()
    (spark.range(0, 1, 1, 1).select(F.lit(run_id).cast("bigint").alias("run_id"),
                           F.lit(generated_at).cast("timestamp_ntz").alias("generated_at"),
                           F.lit(rows).cast("bigint").alias("rows"), F.lit(folder).alias("folder"))
     .write.mode("append").parquet(f"{path}/manifest"))
    return rows


def manifest(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def last_good(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest published run, or None before the first one."""
    newest = manifest(spark, path).orderBy(F.desc("run_id")).first()
    if newest is None:
        return None
    data = spark.read.parquet(f"{path}/{newest['folder']}")
    if data.count() != newest["rows"]:
        raise ValueError(f"run {newest['run_id']} does not have the {newest['rows']} rows of its manifest")
    return data


@contextmanager
def reading(spark: SparkSession, path: str, until) -> Iterator[DataFrame]:
    """The newest published run, leased: it is not deleted before the block ends, or before ``until`` where it never does.

    The lease is made first and the run looked up again, so that a run which went in between is not read.
    """
    while True:
        newest = manifest(spark, path).orderBy(F.desc("run_id")).first()
        if newest is None:
            raise LookupError(f"nothing is published in {path}")
        files, lease = _files(spark, f"{path}/leases/{newest['run_id']}-{uuid.uuid4().hex}")
        stream = files.create(lease, False)
        moment = spark.range(1).select(as_ts(until).cast("string")).first()[0]
        stream.write(bytearray(moment.encode()))
        stream.close()
        if not manifest(spark, path).where(F.col("run_id") == newest["run_id"]).isEmpty():
            break
        files.delete(lease, False)
    try:
        yield spark.read.parquet(f"{path}/{newest['folder']}")
    finally:
        files.delete(lease, False)


def _leased(spark: SparkSession, path: str, now: str) -> set[int]:
    """Runs with a lease that holds at ``now``; leases that have ended are removed."""
    files, folder = _files(spark, f"{path}/leases")
    runs = set()
    for f in files.listStatus(folder) if files.exists(folder) else []:
        until = _text(files, f.getPath())
        if not until or until > now:  # an empty one is being made
            runs.add(int(f.getPath().getName().split("-")[0]))
        else:
            files.delete(f.getPath(), False)
    return runs


def expire(spark: SparkSession, path: str, keep: int, now) -> list[int]:
    """Delete all runs but the newest ``keep`` and those leased at ``now``; returns the run ids that went.

    A run's manifest row goes first, so it is invisible before its rows go. What failed
    attempts at runs up to the oldest one kept have left goes, too; attempts at newer runs
    may still be under way. Numbers of runs rise. With an expiry after each publication the
    folder holds ``keep`` runs, the leased ones, and attempts since the oldest kept run.
    """
    if keep < 1:
        raise ValueError("the newest run always stays")
    now = spark.range(1).select(as_ts(now).cast("string")).first()[0]
    listed = manifest(spark, path).select("run_id", "folder", F.input_file_name().alias("file")).orderBy(F.desc("run_id")).collect()
    if not listed:
        return []
    leased = _leased(spark, path, now)
    kept = [r for place, r in enumerate(listed) if place < keep or r["run_id"] in leased]
    gone = [r for r in listed if r not in kept]
    for r in gone:
        files, row = _files(spark, r["file"])
        files.delete(row, False)
    folders, floor = {r["folder"] for r in kept}, listed[min(keep, len(listed)) - 1]["run_id"]
    files, data = _files(spark, f"{path}/data")
    for run in files.listStatus(data):
        number = int(run.getPath().getName().removeprefix("run_id="))
        attempts = [a.getPath() for a in files.listStatus(run.getPath())]
        dead = [a for a in attempts if f"data/{run.getPath().getName()}/{a.getName()}" not in folders]
        if number <= floor:
            for a in dead:
                files.delete(a, True)
            if len(dead) == len(attempts):
                files.delete(run.getPath(), True)
    return sorted(r["run_id"] for r in gone)


def refresh(spark: SparkSession, path: str, run_id: int, generated_at,
            build: Callable[[], DataFrame]) -> str:
    """Build and publish; on any failure the last good run stays. Returns ``ok`` or the error."""
    try:
        publish_forecast(build(), path, run_id, generated_at)
        return "ok"
    except Exception as error:  # noqa: BLE001 - a failed refresh must not take the service down
        return f"{type(error).__name__}: {error}"
