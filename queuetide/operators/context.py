"""Gap runs, seasonal bridging, and the forecaster's context per key.

All of it works on observed slots and their distance to the next one; the only
rows ever generated are the slots that are really filled.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..constants import (CONTEXT_DAYS, FORECAST_STEP, HORIZON_STEPS, KEY, HISTORY_DAYS, LAG_DAYS, MAX_CONTEXT_AGE_MIN,
                         MAX_FILL_STEPS, TS, VALUE)
from ..functions.calendar import as_ts, floor_to, minutes_between, resolved, steps_between, time_covariates
from ..session import materialise
from ..sources.observations import assert_complete, history_window, typed
from .grid import step_interval
from .profiles import Profiles, build_profiles, lag_lookup, profile_lookup


def _by_slot():
    return W.partitionBy(KEY).orderBy("slot")


def gap_runs(grid: DataFrame, step: int = FORECAST_STEP) -> DataFrame:
    """Each run of missing slots: first missing, first present after, length."""
    nxt = F.lead("slot").over(_by_slot())
    return (grid.withColumn("_next", nxt)
            .withColumn("length", steps_between("_next", "slot", step) - 1)
            .where(F.col("length") > 0)
            .select(KEY, (F.col("slot") + step_interval(step)).alias("start"), F.col("_next").alias("stop"), "length"))


def with_gaps(grid: DataFrame, step: int = FORECAST_STEP) -> DataFrame:
    """Observed rows with the next slot and the number of missing slots up to it."""
    return (grid.withColumn("next_slot", F.lead("slot").over(_by_slot()))
            .withColumn("gap", F.coalesce(steps_between("next_slot", "slot", step) - 1, F.lit(0))))


def bridge(observed: DataFrame, profiles: Profiles, step: int = FORECAST_STEP,
           max_gap: int = MAX_FILL_STEPS) -> DataFrame:
    """Observed rows plus bridged slots (``filled`` tells which).

    Only interior gaps of at most ``max_gap`` slots are bridged, with the profile
    plus a residual that drifts from the left edge's to the right edge's, not
    below zero. ``observed`` comes from :func:`with_gaps`.
    """
    edges = profile_lookup(observed, profiles, slot_name="_p", time_name="_pt").withColumn(
        "_left", F.col(VALUE) - F.col("_p"))
    edges = edges.withColumn("_right", F.lead("_left").over(_by_slot()))
    steps = F.when(F.col("gap") <= max_gap, F.col("gap")).otherwise(0)
    rows = (edges.withColumn("_i", F.explode(F.sequence(F.lit(0), steps)))
            .withColumn("slot", F.col("slot") + F.col("_i") * step_interval(step))
            .drop("_p", "_pt"))
    rows = profile_lookup(rows, profiles, slot_name="_p", time_name="_pt")
    weight = F.col("_i") / (F.col("gap") + 1)
    drift = F.col("_left") + (F.col("_right") - F.col("_left")) * weight
    return rows.withColumns({
        VALUE: F.when(F.col("_i") == 0, F.col(VALUE)).otherwise(F.greatest(F.lit(0.0), F.col("_p") + drift)),
        "filled": F.col("_i") > 0,
    }).drop("_i", "_left", "_right", "_p", "_pt", "next_slot", "gap")


def seasonal_fill(grid: DataFrame, profiles: Profiles, step: int = FORECAST_STEP,
                  max_gap: int = MAX_FILL_STEPS) -> DataFrame:
    return bridge(with_gaps(grid, step), profiles, step, max_gap)


def _segment_start(max_gap: int) -> Column:
    w = W.partitionBy(KEY)
    broken = F.when(F.col("gap") > max_gap, F.col("next_slot"))
    return F.coalesce(F.max(broken).over(w), F.min("slot").over(w))


def latest_segment(observed: DataFrame, max_gap: int = 0) -> DataFrame:
    """Rows of the most recent run without a gap above ``max_gap`` (the most recent, not the longest)."""
    return (observed.withColumn("segment_start", _segment_start(max_gap))
            .where(F.col("slot") >= F.col("segment_start")))


@dataclass(frozen=True)
class Prepared:
    """``context``: rows of usable keys with covariates. ``stats``: one row per key.
    ``grid`` and ``profiles`` are kept for the future rows."""

    context: DataFrame
    stats: DataFrame
    grid: DataFrame
    profiles: Profiles


def _counted_grid(raw: DataFrame, step: int) -> DataFrame:
    """Grid means and the raw row counts of each slot, from one pass over the input."""
    df = typed(raw)
    good = F.when(F.col(TS).isNotNull() & (F.col(VALUE) >= 0) & ~F.isnan(VALUE), F.col(VALUE))
    return df.groupBy(KEY, floor_to(TS, step).alias("slot")).agg(
        F.avg(good).alias(VALUE), F.count(F.lit(1)).alias("_raw"), F.count(good).alias("_valid"),
        F.count_if(F.col(VALUE) < 0).alias("_negative"))


def context_stats(counted: DataFrame, as_of, step: int, days: int, max_gap: int, min_rows: int,
                  max_age: int, keys: DataFrame | None = None) -> DataFrame:
    """The statistics and the first matching status of every key."""
    totals = counted.groupBy(KEY).agg(
        F.sum("_raw").alias("raw_rows"), F.sum("_valid").alias("valid_rows"),
        F.sum("_negative").alias("negative_sentinel_rows"))
    if keys is not None:
        totals = keys.select(KEY).distinct().join(totals, KEY, "left").na.fill(0)
    recent = _recent(counted, days)
    seg = (with_gaps(recent, step).withColumn("_seg", _segment_start(max_gap))
           .withColumn("_in", F.col("slot") >= F.col("_seg"))
           .groupBy(KEY).agg(
               F.min("slot").alias("_first"), F.max("slot").alias("window_end"),
               F.count(F.lit(1)).alias("window_observed_rows"),
               F.sum(F.when(F.col("gap") <= max_gap, F.col("gap")).otherwise(0)).alias("rows_seasonally_filled"),
               F.max(F.when(F.col("gap") <= max_gap, F.col("gap")).otherwise(0)).alias("longest_gap_filled_steps"),
               F.max("_seg").alias("selected_segment_start"), F.count_if("_in").alias("_kept")))
    s = totals.join(seg, KEY, "left").withColumns({
        "window_start": F.col("window_end") - F.expr(f"INTERVAL '{days}' DAY"),
        "window_grid_rows": F.coalesce(steps_between("window_end", "_first", step) + 1, F.lit(0)).cast("bigint"),
        "_rows": F.coalesce(steps_between("window_end", "selected_segment_start", step) + 1, F.lit(0)).cast("bigint"),
        "_age": minutes_between(as_ts(as_of), "window_end"),
    }).na.fill(0, ["window_observed_rows", "rows_seasonally_filled", "longest_gap_filled_steps", "_kept"])
    status = (F.when(F.col("raw_rows") == 0, "no_rows").when(F.col("valid_rows") == 0, "no_valid_rows")
              .when(F.col("_age") > max_age, "stale_history")
              .when(F.col("_rows") < min_rows, "insufficient_history").otherwise("ok"))
    needing = F.col("window_grid_rows") - F.col("window_observed_rows")
    stats = s.withColumns({
        "status": status,
        "selected_segment_end": F.col("window_end"),
        "rows_needing_fill": needing,
        "rows_not_needing_fill": F.col("window_observed_rows"),
        "rows_missing_after_fill": needing - F.col("rows_seasonally_filled"),
        "window_coverage_ratio": F.when(F.col("window_grid_rows") > 0,
                                        F.col("window_observed_rows") / F.col("window_grid_rows")).otherwise(0.0),
        "context_synthetic_ratio": F.when(F.col("_rows") > 0,
                                          1.0 - F.col("_kept") / F.col("_rows")).otherwise(0.0),
        "context_age_minutes": F.floor("_age").cast("int"),
        "context_rows": F.when(F.col("_age") <= max_age, F.col("_rows")).otherwise(F.lit(0).cast("bigint")),
        "window_days": F.lit(days),
    })
    # The wording of the messages.
    message = (F.when(F.col("status") == "no_rows", "No rows found for airport")
               .when(F.col("status") == "no_valid_rows", "No valid queue history after cleanup")
               .when(F.col("status") == "stale_history", F.concat(
                   F.lit("Most recent history ends "), F.date_format("window_end", "yyyy-MM-dd'T'HH:mm:ss"),
                   F.lit(", "), F.col("context_age_minutes").cast("string"),
                   F.lit(f" min ago (limit {max_age}); refusing to forecast an elapsed window")))
               .when(F.col("status") == "insufficient_history", F.concat(
                   F.lit("Not enough history after preprocessing: "), F.col("context_rows").cast("string"),
                   F.lit(" rows"))).otherwise(""))
    return stats.withColumn("status_message", message).select(
        KEY, "raw_rows", "valid_rows", "negative_sentinel_rows", "rows_needing_fill", "rows_not_needing_fill",
        "rows_seasonally_filled", "longest_gap_filled_steps", "rows_missing_after_fill", "context_rows",
        "context_synthetic_ratio", "context_age_minutes", "window_days", "window_start", "window_end",
        "window_grid_rows", "window_observed_rows", "window_coverage_ratio", "selected_segment_start",
        "selected_segment_end", "status", "status_message")


def _recent(counted: DataFrame, days: int) -> DataFrame:
    """Observed slots of the last ``days`` before each key's own last slot, both ends in."""
    seen = counted.where(F.col(VALUE).isNotNull() & F.col("slot").isNotNull()).select(KEY, "slot", VALUE)
    last = F.max("slot").over(W.partitionBy(KEY))
    return (seen.withColumn("_last", last)
            .where(F.col("slot") >= F.col("_last") - F.expr(f"INTERVAL '{days}' DAY")).drop("_last"))


def add_covariates(df: DataFrame, grid: DataFrame, profiles: Profiles, ts: str = "slot") -> DataFrame:
    """Clock, profile and lag covariates; a missing lag takes the profile."""
    df = time_covariates(df, ts)
    df = profile_lookup(df, profiles, ts, "queue_avg_dow_time", "queue_avg_time")
    return lag_lookup(df, grid, LAG_DAYS, "queue_avg_dow_time", ts)


def prepare_context(raw: DataFrame, as_of, *, keys: DataFrame | None = None, step: int = FORECAST_STEP,
                    days: int = CONTEXT_DAYS, max_gap: int = MAX_FILL_STEPS,
                    min_rows: int = 2 * HORIZON_STEPS, max_age: int = MAX_CONTEXT_AGE_MIN,
                    history_days: int = HISTORY_DAYS, expected_rows: int | None = None) -> Prepared:
    """Bound the history, clean, grid, bridge, cut to the latest segment, refuse unusable keys, add covariates.

    The grid with its row counts is written to the shared folder first: the profiles,
    the statistics, the context and the lags all start from it, the raw rows are read
    once. Only the last ``history_days`` before ``as_of`` count; a literal ``as_of`` prunes
    partitions of a typed table. A key of ``keys`` with older rows only has no rows. With
    ``expected_rows`` the run fails if the bounded history has fewer.
    """
    as_of = resolved(raw.sparkSession, as_of)
    recent = history_window(typed(raw).select(KEY, TS, VALUE), as_of, history_days)
    counted = materialise(_counted_grid(assert_complete(recent, expected_rows), step), "grid")
    grid = counted.where(F.col(VALUE).isNotNull() & F.col("slot").isNotNull()).select(KEY, "slot", VALUE)
    profiles = build_profiles(grid, tz=None, bucket=1)
    # Looked up for the context and for the future rows, twice each.
    profiles = replace(profiles, times=materialise(profiles.times, "times"), overall=materialise(profiles.overall, "overall"))
    stats = context_stats(counted, as_of, step, days, max_gap, min_rows, max_age, keys)

    segment = latest_segment(with_gaps(_recent(counted, days), step), max_gap).drop("segment_start")
    usable = stats.where("status = 'ok'").select(KEY)
    context = bridge(segment, profiles, step, max_gap).join(usable, KEY, "left_semi")
    return Prepared(add_covariates(context, grid, profiles), stats, grid, profiles)


def future_grid(prepared: Prepared, n: int = HORIZON_STEPS, step: int = FORECAST_STEP) -> DataFrame:
    """The next ``n`` slots of every usable key with the same covariates."""
    ahead = (prepared.stats.where("status = 'ok'")
             .select(KEY, F.explode(F.sequence(
                 F.col("selected_segment_end") + step_interval(step),
                 F.col("selected_segment_end") + step_interval(n * step), step_interval(step))).alias("slot")))
    return add_covariates(ahead, prepared.grid, prepared.profiles)
