"""A forecast model as a predictor of the backtest: its context as of every origin, in one plan.

Each (key, origin) is a series of its own. What a series may see is settled once per
slot of the history: where the run without a long gap began that holds the slot, by a
running maximum. An origin takes that of the last slot before it, so no context is
looked for again at every origin. The slot that an origin cuts in two counts with its
readings up to the origin only, in the context as in the profiles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..constants import (CONTEXT_DAYS, FORECAST_LEVELS, FORECAST_STEP, HORIZON_STEPS, KEY, LAG_DAYS, MAX_CONTEXT_AGE_MIN,
                         MAX_FILL_STEPS, VALUE)
from ..functions.calendar import floor_to, minutes_between, steps_between, time_covariates
from ..operators.asof import asof_nearest
from ..operators.context import bridge, with_gaps
from ..operators.grid import step_interval
from ..operators.profiles import Profiles, asof_cube, lag_lookup, origin_number, profile_lookup, profiles_by_origin
from ..session import materialise
from .backtest import Predictor, Setup
from .forecast import Model, format_forecast


@dataclass(frozen=True)
class SeriesContexts:
    """``observed``: slots of usable series. ``series``: one row per usable series with its
    end. Both name the key in ``source``; in all frames the key column holds the series."""

    observed: DataFrame
    series: DataFrame
    grid: DataFrame
    profiles: Profiles


def series_name(key=KEY, origin="origin") -> Column:
    return F.concat_ws(" @ ", F.col(key), F.date_format(F.col(origin), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def _cut_slots(history: DataFrame, origins: DataFrame, step: int) -> DataFrame:
    """(key, origin, _o, _at, _cut): mean of the readings between an origin's slot and the origin."""
    own = history.select(KEY, floor_to("slot", step).alias("_at"), F.col("slot").alias("_seen"), VALUE)
    return (origins.join(own, [KEY, "_at"]).where(F.col("_seen") <= F.col("origin"))
            .groupBy(KEY, "origin", "_o", "_at").agg(F.avg(VALUE).alias("_cut")))


def _run_starts(grid: DataFrame, step: int, max_gap: int) -> DataFrame:
    """Every observed slot with the start of the run that holds it: no gap above ``max_gap`` in between."""
    by_slot = W.partitionBy(KEY).orderBy("slot")
    gap = steps_between("slot", F.lag("slot").over(by_slot), step) - 1
    starts = F.when(gap.isNull() | (gap > max_gap), F.col("slot"))
    return (grid.select(KEY, "slot", starts.alias("_start"))
            .withColumn("_start", F.max("_start").over(by_slot.rowsBetween(W.unboundedPreceding, W.currentRow))))


def contexts_at_origins(history: DataFrame, frame: DataFrame, setup: Setup, step: int = FORECAST_STEP,
                        days: int = CONTEXT_DAYS, max_gap: int = MAX_FILL_STEPS, min_rows: int = 2 * HORIZON_STEPS,
                        max_age: int = MAX_CONTEXT_AGE_MIN) -> SeriesContexts:
    """The context of every (key, origin) of ``frame``, by the rules of ``prepare_context`` as of the origin.

    Origins without a slot, older than ``max_age`` minutes or with fewer than ``min_rows``
    slots, filled ones included, have no series.
    """
    setup = setup.resolved(history.sparkSession)
    grid = materialise(history.groupBy(KEY, floor_to("slot", step).alias("slot")).agg(F.avg(VALUE).alias(VALUE)), "grid")
    hours, first = setup.origin_every_hours, setup.first_origin
    origins = materialise(frame.select(KEY, "origin").distinct().withColumns({
        "_o": origin_number("origin", first, hours), "_at": floor_to("origin", step)}), "origins")
    cut = materialise(_cut_slots(history, origins, step), "cut")

    # A whole slot is known from the first origin at or after its end.
    whole = F.col("slot") + step_interval(step)
    newest = (_run_starts(grid, step, max_gap).groupBy(KEY, origin_number(whole, first, hours).alias("_o"))
              .agg(F.max(F.struct("slot", "_start")).alias("_last")))
    so_far = W.partitionBy(KEY).orderBy("_o").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = (newest.unionByName(origins.select(KEY, "_o"), allowMissingColumns=True)
            .groupBy(KEY, "_o").agg(F.max("_last").alias("_last"))
            .withColumn("_last", F.last("_last", ignorenulls=True).over(so_far)))
    joins_on = steps_between("_at", "_last.slot", step) - 1 <= max_gap
    ends = (origins.join(last, [KEY, "_o"], "left").join(cut.select(KEY, "_o", "_cut"), [KEY, "_o"], "left")
            .withColumns({"end": F.when(F.col("_cut").isNotNull(), F.col("_at")).otherwise(F.col("_last.slot")),
                          "_start": F.when(F.col("_cut").isNotNull() & ~F.coalesce(joins_on, F.lit(False)), F.col("_at"))
                          .otherwise(F.col("_last._start"))})
            .where(F.col("end").isNotNull() & (minutes_between("origin", "end") <= max_age))
            .withColumns({"_from": F.greatest("_start", F.col("end") - F.expr(f"INTERVAL '{days}' DAY")), "series": series_name()}))
    ends = materialise(ends.select(KEY, "origin", "_o", "_at", "_cut", "end", "_from", "series"), "ends")

    # A slot meets its key's origins as one row and is repeated for those that see it, no other.
    spans = ends.groupBy(KEY).agg(F.collect_list(F.struct("series", "_from", "_at", "end")).alias("_spans"))
    sees = F.filter("_spans", lambda s: (s["_from"] <= F.col("slot")) & (F.col("slot") < s["_at"]))
    rows = (grid.join(spans, KEY).select(F.col(KEY).alias("source"), "slot", VALUE, F.explode(sees).alias("s"))
            .select(F.col("s.series").alias(KEY), "source", "slot", VALUE, F.col("s.end").alias("end")))
    own = ends.where(F.col("_cut").isNotNull()).select(
        F.col("series").alias(KEY), F.col(KEY).alias("source"), F.col("_at").alias("slot"), F.col("_cut").alias(VALUE), "end")
    begin = F.min("slot").over(W.partitionBy(KEY))
    observed = (rows.unionByName(own).withColumn("_begin", begin)
                .where(steps_between("end", "_begin", step) + 1 >= min_rows).drop("_begin"))
    observed = materialise(observed, "contexts")
    series = observed.select(KEY, "source", "end").distinct()

    cube = asof_cube(grid, first, hours, None, 1, known=whole)
    # What an origin cuts off counts there, and is taken back at the next one.
    part = asof_cube(cut.select(KEY, "origin", F.col("_at").alias("slot"), F.col("_cut").alias(VALUE)), first, hours, None, 1,
                     known=F.col("origin"))
    back = part.withColumns({"_o": F.col("_o") + 1, "total": -F.col("total"), "n": -F.col("n")})
    profiles = profiles_by_origin(cube.unionByName(part).unionByName(back), ends, None, 1)
    times = materialise(profiles.times, "times")
    return SeriesContexts(observed.drop("end"), series, grid, Profiles(times, materialise(profiles.overall, "overall"), None, 1))


def _covariates(df: DataFrame, contexts: SeriesContexts) -> DataFrame:
    """As ``add_covariates``; exact lags are the key's, as they lie before any origin that asks."""
    df = profile_lookup(time_covariates(df, "slot"), contexts.profiles, "slot", "queue_avg_dow_time", "queue_avg_time")
    df = df.withColumnsRenamed({KEY: "series", "source": KEY})
    return lag_lookup(df, contexts.grid, LAG_DAYS, "queue_avg_dow_time").withColumnsRenamed({KEY: "source", "series": KEY})


def context_rows(contexts: SeriesContexts, step: int = FORECAST_STEP, max_gap: int = MAX_FILL_STEPS) -> DataFrame:
    """Observed and bridged slots of every series with their covariates."""
    return _covariates(bridge(with_gaps(contexts.observed, step), contexts.profiles, step, max_gap), contexts)


def future_rows(contexts: SeriesContexts, n: int = HORIZON_STEPS, step: int = FORECAST_STEP) -> DataFrame:
    """The next ``n`` slots of every series with their covariates."""
    ahead = F.sequence(F.col("end") + step_interval(step), F.col("end") + step_interval(n * step), step_interval(step))
    return _covariates(contexts.series.select(KEY, "source", F.explode(ahead).alias("slot")), contexts)


def model_as_predictor(model: Model, step: int = FORECAST_STEP, n: int = HORIZON_STEPS,
                       levels: list[float] = FORECAST_LEVELS, max_gap: int = MAX_FILL_STEPS, **rules) -> Predictor:
    """Use a forecast model where the backtest asks for a predictor.

    The model gets the contexts of all origins at once; to it a (key, origin) is a key,
    and ``source`` names the key proper. A target takes the forecast point nearest to
    it within half a step, the later of two; beyond the horizon it has no prediction.
    """

    def predict(history: DataFrame, frame: DataFrame, setup: Setup) -> DataFrame:
        contexts = contexts_at_origins(history, frame, setup, step, max_gap=max_gap, **rules)
        made = model(context_rows(contexts, step, max_gap), future_rows(contexts, n, step), levels)
        points = format_forecast(made, levels).select(
            KEY, F.col("timestamp").alias("slot"), "mean",
            *[F.col("quantiles")[level].alias(name) for level, name in (("0.1", "q10"), ("0.5", "q50"), ("0.9", "q90"))])
        asked = frame.withColumn("source", F.col(KEY)).withColumn(KEY, series_name())
        near = asof_nearest(asked, points, ["mean", "q10", "q50", "q90"], within_min=step / 2, target_ts="target", sample_ts="slot")
        return near.drop(KEY).withColumnRenamed("source", KEY)

    return predict
