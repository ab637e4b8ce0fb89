"""The value shown as "now", upcoming points, and the merged past/future series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..constants import KEY, LIVE_STALE_MIN, TS, VALUE
from ..functions.calendar import as_ts
from ..functions.numbers import eased, round_up_half
from .latest import latest_per_key


def upcoming(forecasts: DataFrame, as_of) -> DataFrame:
    """Forecast points not yet past, not below zero; placeholders are dropped."""
    return (forecasts.where(F.col("mean").isNotNull() & (F.col(TS) >= as_ts(as_of)))
            .withColumn("mean", F.greatest("mean", F.lit(0.0))))


def within_hours(points: DataFrame, as_of, hours: int = 2) -> DataFrame:
    return points.where(F.col(TS) <= as_ts(as_of) + F.expr(f"INTERVAL '{hours}' HOUR"))


def next_hours_average(points: DataFrame, as_of, hours: int = 2) -> DataFrame:
    """Rounded mean of the next hours; the first point stands in where none is that near."""
    near = F.col(TS) <= as_ts(as_of) + F.expr(f"INTERVAL '{hours}' HOUR")
    mean = F.coalesce(F.avg(F.when(near, F.col("mean"))), F.min_by("mean", TS))
    return points.groupBy(KEY).agg(
        round_up_half(F.greatest(F.lit(0.0), mean)).cast("bigint").alias("next_hours_average"))


def effective_queue(obs: DataFrame, predicted: DataFrame, points: DataFrame, as_of,
                    stale_min: int = LIVE_STALE_MIN, keys: DataFrame | None = None) -> DataFrame:
    """Latest reading while fresh; else the prediction for now; else the first
    upcoming forecast; else the last known reading.

    ``predicted``: (key, predicted); ``points``: upcoming forecast rows. With ``keys``
    (column key) each of them has a row; one without readings has only what predictions
    give, NULL if there are none.
    """
    latest = latest_per_key(obs)
    if keys is not None:
        latest = keys.select(KEY).distinct().join(latest, KEY, "left")
    first = points.groupBy(KEY).agg(F.min_by("mean", TS).alias("_forecast"))
    fresh = F.col(TS) >= as_ts(as_of) - F.expr(f"INTERVAL '{stale_min}' MINUTE")
    stand_in = F.coalesce(round_up_half("predicted"), round_up_half("_forecast"))
    return (latest.join(predicted.select(KEY, "predicted"), KEY, "left").join(first, KEY, "left")
            .select(KEY, F.when(fresh, "live").when(F.col("predicted").isNotNull(), "predicted")
                    .when(F.col("_forecast").isNotNull(), "forecast").when(F.col(TS).isNotNull(), "last_known").alias("origin"),
                    F.when(fresh, F.col(VALUE)).otherwise(
                        F.coalesce(stand_in.cast("double"), F.col(VALUE))).alias("effective")))


def blended(points: DataFrame, last: DataFrame) -> DataFrame:
    """Forecast eased in from the last value over the key's points.

    A key has one point per forecast step, so its window is small.
    """
    order = W.partitionBy(KEY).orderBy(TS)
    progress = F.row_number().over(order) / F.count(F.lit(1)).over(W.partitionBy(KEY))
    return (points.join(last.select(KEY, F.col("effective").alias("_last")), KEY, "left")
            .withColumn("prediction", eased("_last", "mean", progress)).drop("_last"))


def merge_past_future(past: DataFrame, points: DataFrame, live: DataFrame) -> DataFrame:
    """One series per key: past readings, then the eased forecast.

    The last past point takes the live value and repeats it as prediction, so the
    two lines meet. ``past_share`` is past points over all points less one.
    ``past`` is the result of :func:`last_n_per_key` (``rn`` 1 is the newest).
    """
    now = live.select(KEY, F.col("effective").alias("_now"))
    newest = F.col("rn") == 1
    value = F.when(newest, F.coalesce("_now", VALUE)).otherwise(F.col(VALUE))
    before = past.join(now, KEY, "left").select(
        KEY, TS, value.alias("past"), F.when(newest, value).alias("prediction"), F.lit(0).alias("part"))
    after = blended(points, live).select(KEY, TS, "prediction", F.lit(1).alias("part"))
    both = before.unionByName(after, allowMissingColumns=True)
    w = W.partitionBy(KEY)
    n, n_past = F.count(F.lit(1)).over(w), F.count_if(F.col("part") == 0).over(w)
    return both.withColumn("past_share", F.when((n_past > 0) & (n > 1), n_past / (n - 1)).otherwise(0.0))
