"""As-of and nearest lookups without inequality joins.

Samples and targets are split by (key, minute). What a minute cannot see, the last
sample before it and the first after it, is carried in as one extra row each.
Windows then run per minute, so one key never has to fit a single task. Samples that
share a timestamp are reduced to one, and targets to distinct moments, before the
shuffle on minutes: a part cannot grow past the microseconds of its minute, however
many rows a key has. The carries come from one row per (key, minute).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..constants import KEY, TS
from ..functions.calendar import floor_micros, micros

MINUTE_US = 60_000_000


def neighbours(targets: DataFrame, samples: DataFrame, value: list[str], *, target_ts: str = TS,
               sample_ts: str = TS, key: str = KEY, tie: str | None = None,
               back: bool = True, ahead: bool = True) -> DataFrame:
    """Distinct (key, target moment) with structs ``prev`` and ``next`` of samples.

    ``prev`` is the last sample at or before the moment, ``next`` the first at or
    after it (of samples with one timestamp the one with the highest ``tie``, or
    without ``tie`` each column's largest value); each holds ``us`` (its time in microseconds) and the value columns.
    """
    # Columns are picked one by one: fixed-width buffers keep the aggregates hash based.
    picks = [F.max_by(v, tie).alias(v) if tie else F.max(v).alias(v) for v in value]
    points = (samples.where(F.col(sample_ts).isNotNull())
              .groupBy(F.col(key).alias(key), micros(sample_ts).alias("us")).agg(*picks)
              .select(key, "us", F.lit(0).alias("side"), *value))
    asked = (targets.where(F.col(target_ts).isNotNull())
             .select(F.col(key).alias(key), micros(target_ts).alias("us")).distinct()
             .withColumn("side", F.lit(1)))
    both = points.unionByName(asked, allowMissingColumns=True).withColumn(
        "b", floor_micros(F.col("us"), MINUTE_US))

    at = F.when(F.col("side") == 0, F.col("us"))
    ends = both.groupBy(key, "b").agg(
        F.min(at).alias("_low"), F.max(at).alias("_high"), F.max("side").alias("asked"),
        *[F.min_by(v, at).alias(f"_low_{v}") for v in value], *[F.max_by(v, at).alias(f"_high_{v}") for v in value])

    def sample(end: str) -> Column:
        """The bucket's first or last sample as a struct; NULL where it has none."""
        fields = [F.col(end).alias("us"), *[F.col(f"{end}_{v}").alias(v) for v in value]]
        return F.when(F.col(end).isNotNull(), F.struct(*fields))

    ends = ends.select(key, "b", "asked", sample("_low").alias("low"), sample("_high").alias("high"))
    carried = []
    if back:
        before = F.last("high", ignorenulls=True).over(
            W.partitionBy(key).orderBy("b").rowsBetween(W.unboundedPreceding, -1))
        carried.append(ends.withColumn("s", before))
    if ahead:
        after = F.last("low", ignorenulls=True).over(
            W.partitionBy(key).orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, -1))
        carried.append(ends.withColumn("s", after))
    own = F.when(F.col("side") == 0, F.struct("us", *value))
    rows = both.select(key, "us", "side", own.alias("s"), "b")
    for extra in carried:
        rows = rows.unionByName(extra.where("asked = 1 and s is not null")
                                .select(key, F.col("s.us").alias("us"), F.lit(0).alias("side"), "s", "b"))

    part = W.partitionBy(key, "b")
    up = part.orderBy("us", "side").rowsBetween(W.unboundedPreceding, W.currentRow)
    down = part.orderBy(F.desc("us"), "side").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = {}
    if back:
        found["prev"] = F.last("s", ignorenulls=True).over(up)
    if ahead:
        found["next"] = F.last("s", ignorenulls=True).over(down)
    return rows.withColumns(found).where("side = 1").select(key, "us", *found)


def _attach(targets: DataFrame, hits: DataFrame, target_ts: str, key: str) -> DataFrame:
    return (targets.withColumn("us", micros(target_ts)).join(hits, [key, "us"], "left").drop("us"))


def asof_backward(targets: DataFrame, samples: DataFrame, value: list[str], *, target_ts: str = TS,
                  sample_ts: str = TS, key: str = KEY, tie: str | None = None,
                  within_min: float | None = None) -> DataFrame:
    """Every target with the latest sample at or before it (NULLs where none)."""
    hits = neighbours(targets, samples, value, target_ts=target_ts, sample_ts=sample_ts, key=key,
                      tie=tie, ahead=False)
    hit = F.col("prev")
    if within_min is not None:
        hit = F.when(F.col("us") - F.col("prev.us") <= int(within_min * 60_000_000), hit)
    hits = hits.select(key, "us", hit.alias("_h")).select(key, "us", *[F.col(f"_h.{v}").alias(v) for v in value])
    return _attach(targets, hits, target_ts, key)


def asof_forward(targets: DataFrame, samples: DataFrame, value: list[str], *, target_ts: str = TS,
                 sample_ts: str = TS, key: str = KEY, tie: str | None = None,
                 within_min: float | None = None) -> DataFrame:
    """Every target with the first sample at or after it."""
    hits = neighbours(targets, samples, value, target_ts=target_ts, sample_ts=sample_ts, key=key,
                      tie=tie, back=False)
    hit = F.col("next")
    if within_min is not None:
        hit = F.when(F.col("next.us") - F.col("us") <= int(within_min * 60_000_000), hit)
    hits = hits.select(key, "us", hit.alias("_h")).select(key, "us", *[F.col(f"_h.{v}").alias(v) for v in value])
    return _attach(targets, hits, target_ts, key)


def asof_nearest(targets: DataFrame, samples: DataFrame, value: list[str], *, within_min: float = 5,
                 target_ts: str = TS, sample_ts: str = TS, key: str = KEY, tie: str | None = None) -> DataFrame:
    """Every target with the nearest sample, tolerance included; ties go to the later."""
    tol = int(within_min * 60_000_000)
    hits = neighbours(targets, samples, value, target_ts=target_ts, sample_ts=sample_ts, key=key,
                      tie=tie)
    behind, beyond = F.col("us") - F.col("prev.us"), F.col("next.us") - F.col("us")
    prev_ok, next_ok = behind <= tol, beyond <= tol
    hit = (F.when(next_ok & (F.col("prev").isNull() | (beyond <= behind)), F.col("next"))
           .when(prev_ok, F.col("prev")))
    hits = hits.select(key, "us", hit.alias("_h")).select(key, "us", *[F.col(f"_h.{v}").alias(v) for v in value])
    return _attach(targets, hits, target_ts, key)


def match_within(requests: DataFrame, forecast: DataFrame, value: list[str], *, within_min: int = 15,
                 target_ts: str = TS, key: str = KEY) -> DataFrame:
    """First forecast point no further than ``within_min`` from the target, not the nearest."""
    early = requests.withColumn("_from", F.col(target_ts) - F.expr(f"INTERVAL '{within_min}' MINUTE"))
    return asof_forward(early, forecast, value, target_ts="_from", key=key, within_min=2 * within_min).drop("_from")
