"""Streaming forms of the grid average, pull health, deduplication and gauges.

Inputs carry TIMESTAMP_NTZ in UTC; event time needs a TIMESTAMP, so it is cast
(session zone UTC) before the watermark and cast back on the way out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import ID, KEY, TS, VALUE
from ..operators.health import succeeded


def event_time(df: DataFrame, late: str = "1 hour", ts: str = TS) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def stream_grid_average(obs: DataFrame, step: int = 15, late: str = "1 hour") -> DataFrame:
    """Tumbling mean per key; a window is emitted once the watermark has passed it."""
    return (event_time(obs, late)
            .groupBy(KEY, F.window(TS, f"{step} minutes").alias("w")).agg(F.avg(VALUE).alias(VALUE))
            .select(KEY, F.col("w.start").cast("timestamp_ntz").alias("slot"), VALUE))


def stream_pull_health(pulls: DataFrame, minutes: int = 10, step: int = 5, late: str = "1 hour") -> DataFrame:
    """Successes, failures and rate per key over sliding windows."""
    return (event_time(pulls, late)
            .groupBy(KEY, F.window(TS, f"{minutes} minutes", f"{step} minutes").alias("w"))
            .agg(F.count_if(succeeded()).alias("successes"),
                 F.count_if(F.col("status") == "failure").alias("failures"))
            .select(KEY, F.col("w.end").cast("timestamp_ntz").alias("at"), "successes", "failures",
                    F.when(F.col("successes") + F.col("failures") > 0,
                           F.col("successes") / (F.col("successes") + F.col("failures"))).alias("success_rate")))


def stream_dedup(obs: DataFrame, late: str = "1 hour") -> DataFrame:
    """One row per (key, timestamp); state is dropped once the watermark has passed."""
    return (event_time(obs, late).dropDuplicatesWithinWatermark([KEY, TS])
            .withColumn(TS, F.col(TS).cast("timestamp_ntz")))


def stream_gauges(obs: DataFrame) -> DataFrame:
    """Latest value per key; run it in update or complete mode."""
    return obs.groupBy(KEY).agg(F.max_by(VALUE, ID).alias(VALUE), F.max(TS).alias("last_at"))
