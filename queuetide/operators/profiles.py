"""Seasonal profiles and their lookups.

A profile set holds means on three levels of one key: ``slot`` (weekday, hour,
minute), ``time`` (hour, minute) and ``all``. Coarser levels are rolled up from
the finest sums, so the history is shuffled once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..constants import KEY, VALUE
from ..functions.calendar import micros, slot_parts, to_local
from ..session import materialise


@dataclass(frozen=True)
class Profiles:
    """``times``: per (key, hour, minute) the mean and the means by weekday (a map of
    at most seven). ``overall``: per key the mean. Both are small next to the history."""

    times: DataFrame
    overall: DataFrame
    tz: str | None
    bucket: int


def _parts(ts, tz: str | None, bucket: int) -> dict[str, Column]:
    return slot_parts(to_local(ts, tz), bucket)


def slot_sums(grid: DataFrame, tz: str | None, bucket: int, ts: str = "slot") -> DataFrame:
    return (grid.groupBy(KEY, *[c.alias(n) for n, c in _parts(ts, tz, bucket).items()])
            .agg(F.sum(VALUE).alias("total"), F.count(VALUE).alias("n")))


def seasonal_profiles(grid: DataFrame, tz: str | None = None, bucket: int = 5, ts: str = "slot") -> DataFrame:
    """All three levels in long form; columns a level does not use are NULL."""
    fine = slot_sums(grid, tz, bucket, ts)
    return (fine.groupingSets([[F.col(KEY), F.col("weekday"), F.col("hour"), F.col("minute")],
                               [F.col(KEY), F.col("hour"), F.col("minute")],
                               [F.col(KEY)]], KEY, "weekday", "hour", "minute")
            .agg((F.sum("total") / F.sum("n")).alias("mean"), F.sum("n").alias("n"),
                 F.when(F.grouping("weekday") == 0, "slot").when(F.grouping("hour") == 0, "time")
                 .otherwise("all").alias("level")))


def build_profiles(grid: DataFrame, tz: str | None = None, bucket: int = 5, ts: str = "slot") -> Profiles:
    return _rolled_up(slot_sums(grid, tz, bucket, ts), tz, bucket)


def _rolled_up(fine: DataFrame, tz: str | None, bucket: int) -> Profiles:
    by_weekday = F.map_from_entries(F.collect_list(F.struct("weekday", F.col("total") / F.col("n"))))
    times = fine.groupBy(KEY, "hour", "minute").agg(
        by_weekday.alias("_by_weekday"), (F.sum("total") / F.sum("n")).alias("_time_mean"),
        F.sum("total").alias("_total"), F.sum("n").alias("_n"))
    overall = times.groupBy(KEY).agg((F.sum("_total") / F.sum("_n")).alias("_all_mean"))
    return Profiles(times.drop("_total", "_n"), overall, tz, bucket)


def profile_lookup(df: DataFrame, profiles: Profiles, ts: str = "slot",
                   slot_name: str = "profile_dow_time", time_name: str = "profile_time") -> DataFrame:
    """Expected value at ``ts``: slot, else time of day, else the key's mean, else 0."""
    parts = _parts(ts, profiles.tz, profiles.bucket)
    looked = (df.withColumns({"_h": parts["hour"], "_m": parts["minute"], "_w": parts["weekday"]})
              .join(profiles.times.withColumnsRenamed({"hour": "_h", "minute": "_m"}), [KEY, "_h", "_m"], "left")
              .join(profiles.overall, KEY, "left"))
    at_time = F.coalesce(F.col("_time_mean"), F.col("_all_mean"), F.lit(0.0))
    at_slot = F.coalesce(F.try_element_at("_by_weekday", F.col("_w")), at_time)
    return (looked.withColumns({slot_name: at_slot, time_name: at_time})
            .drop("_h", "_m", "_w", "_by_weekday", "_time_mean", "_all_mean"))


def lag_lookup(df: DataFrame, history: DataFrame, lags: tuple[int, ...], fallback: str,
               ts: str = "slot", name: str = "queue_lag_{}d") -> DataFrame:
    """Value exactly ``lag`` days earlier, else ``fallback`` (a profile column)."""
    for days in lags:
        moved = history.select(
            KEY, (F.col("slot") + F.expr(f"INTERVAL '{days}' DAY")).alias(ts), F.col(VALUE).alias("_lagged"))
        df = (df.join(moved, [KEY, ts], "left")
              .withColumn(name.format(days), F.coalesce("_lagged", fallback)).drop("_lagged"))
    return df


def origin_number(ts, start, hours: int) -> Column:
    """The number of the first origin at or after ``ts``; origins follow ``start`` every ``hours``."""
    return F.greatest(F.ceil((micros(ts) - micros(start)) / F.lit(hours * 3_600_000_000)), F.lit(0)).cast("int")


_CELL = ["weekday", "hour", "minute"]


def asof_cube(grid: DataFrame, origins_start, origin_hours: int, tz: str | None = None, bucket: int = 5,
              known=None) -> DataFrame:
    """What each origin adds to each cell: (key, weekday, hour, minute, ``_o``, total, n).

    A reading adds to the first origin at or after it, or at or after ``known``. Sums over
    the origins up to one, and over cells, give every level of the profiles known there.
    """
    at = origin_number(F.col("slot") if known is None else known, origins_start, origin_hours)
    return (grid.groupBy(KEY, *[c.alias(n) for n, c in _parts("slot", tz, bucket).items()], at.alias("_o"))
            .agg(F.sum(VALUE).alias("total"), F.count(VALUE).alias("n")))


def profiles_asof(grid: DataFrame, requests: DataFrame, origins_start, origin_hours: int,
                  tz: str | None = None, bucket: int = 5) -> DataFrame:
    """Profile at each request's ``target`` from history up to its ``origin`` only.

    The history is read once, into a cube of what each origin adds; all three levels
    come from the cube and from the distinct cells asked for, both written. Requests
    join these sums as zero rows, and a running sum over the origins gives each its own
    past. A cell's window holds at most two rows per origin and weekday.
    """
    cube = materialise(asof_cube(grid, origins_start, origin_hours, tz, bucket), "cube")
    asked = requests.withColumns({**_parts("target", tz, bucket), "_o": origin_number("origin", origins_start, origin_hours)})
    cells = materialise(asked.select(KEY, *_CELL, "_o").distinct(), "cells")
    means = cells
    for level, cell in {"slot": _CELL, "time": _CELL[1:], "all": []}.items():
        keys = [KEY, *cell]
        wanted = cells.select(*keys, "_o", F.lit(0.0).alias("total"), F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("_ask"))
        run = W.partitionBy(*keys).orderBy("_o").rowsBetween(W.unboundedPreceding, W.currentRow)
        past = (cube.select(*keys, "_o", "total", "n", F.lit(0).alias("_ask")).unionByName(wanted)
                .groupBy(*keys, "_o").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("_ask").alias("_ask"))
                .withColumns({"_t": F.sum("total").over(run), "_c": F.sum("n").over(run)})
                .where("_ask = 1")
                .select(*keys, "_o", F.when(F.col("_c") > 0, F.col("_t") / F.col("_c")).alias(f"_{level}")))
        means = means.join(past, [*keys, "_o"], "left")
    at_time = F.coalesce("_time", "_all", F.lit(0.0))
    means = means.select(KEY, *_CELL, "_o", F.coalesce("_slot", at_time).alias("profile_dow_time"), at_time.alias("profile_time"))
    return asked.join(means, [KEY, *_CELL, "_o"], "left").drop("_o", *_CELL)


def profiles_by_origin(cube: DataFrame, series: DataFrame, tz: str | None = None, bucket: int = 5) -> Profiles:
    """The profiles known at each origin, as a set whose keys are series.

    ``series`` names for a key and origin number ``_o`` the series that looks from there;
    a cell's sums hold from one origin that adds to it until the next, and are repeated
    for the series in between.
    """
    ordered = W.partitionBy(KEY, *_CELL).orderBy("_o")
    run = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    past = (cube.groupBy(KEY, *_CELL, "_o").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
            .withColumns({"total": F.sum("total").over(run), "n": F.sum("n").over(run), "_until": F.lead("_o").over(ordered)}))
    of_key = series.groupBy(KEY).agg(F.collect_list(F.struct("_o", "series")).alias("_all"))
    within = F.filter("_all", lambda s: (s["_o"] >= F.col("_o")) & (F.col("_until").isNull() | (s["_o"] < F.col("_until"))))
    fine = (past.join(of_key, KEY).where(F.col("n") > 0)
            .select(F.explode(within).alias("s"), *_CELL, "total", "n")
            .select(F.col("s.series").alias(KEY), *_CELL, "total", "n"))
    return _rolled_up(fine, tz, bucket)
