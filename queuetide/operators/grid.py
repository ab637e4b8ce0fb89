"""Regular grids: averaging onto slots, dense slots, forward fill, duplicates.

Averaging comes first in every job. It combines on the map side, so a key that
holds a large share of the raw rows shrinks before any shuffle, and afterwards a
key has at most one row per slot of the covered time. Windows per key are only
ever taken over such slot rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..constants import FORECAST_STEP, ID, KEY, TS, VALUE
from ..functions.calendar import ceil_to, floor_to, steps_between


def step_interval(step: int):
    return F.expr(f"INTERVAL '{step}' MINUTE")


def grid_average(df: DataFrame, step: int = FORECAST_STEP) -> DataFrame:
    """Mean per (key, slot) after flooring to ``step`` minutes."""
    return (df.groupBy(KEY, floor_to(TS, step).alias("slot"))
            .agg(F.avg(VALUE).alias(VALUE)))


def regular_grid(grid: DataFrame, step: int = FORECAST_STEP) -> DataFrame:
    """Every slot from a key's first to its last; a missing one has a NULL value.

    Each observed slot also emits the empty slots up to the next one, so no join
    against a dense calendar is needed.
    """
    w = W.partitionBy(KEY).orderBy("slot")
    span = F.coalesce(steps_between(F.lead("slot").over(w), "slot", step) - 1, F.lit(0))
    return (grid.withColumn("_span", span)
            .select(KEY, "slot", VALUE, F.explode(F.sequence(F.lit(0), F.col("_span"))).alias("_i"))
            .select(KEY, (F.col("slot") + F.col("_i") * step_interval(step)).alias("slot"),
                    F.when(F.col("_i") == 0, F.col(VALUE)).alias(VALUE)))


def drop_duplicate_ts(df: DataFrame) -> DataFrame:
    """One row per (key, timestamp): the one with the lowest id."""
    rest = [c for c in df.columns if c not in (KEY, TS)]
    return df.groupBy(KEY, TS).agg(*[F.min_by(c, ID).alias(c) for c in rest]).select(*df.columns)


def resample_ffill(df: DataFrame, step: int = 5) -> DataFrame:
    """Last row at or before each grid point, from the first point that has one.

    Only the last row ahead of a grid point can be seen at that point, so rows are
    first reduced to one per (key, next grid point). Timestamps are unique per key,
    see :func:`drop_duplicate_ts`.
    """
    rest = [c for c in df.columns if c not in (KEY, TS)]
    seen = (df.groupBy(KEY, ceil_to(TS, step).alias("slot"))
            .agg(*[F.max_by(c, TS).alias(c) for c in rest], F.max(floor_to(TS, step)).alias("_floor")))
    w = W.partitionBy(KEY).orderBy("slot")
    last_point = F.max("_floor").over(W.partitionBy(KEY))
    until = F.coalesce(F.lead("slot").over(w) - step_interval(step), F.col("_end"))
    return (seen.withColumn("_end", last_point)
            .withColumn("_until", until)
            .where(F.col("slot") <= F.col("_end"))
            .select(KEY, F.explode(F.sequence("slot", F.least("_until", "_end"), step_interval(step))).alias(TS), *rest))
