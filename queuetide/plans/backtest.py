"""Rolling-origin backtest as one plan over all keys, origins and horizons.

A predictor is a function ``(history, frame, setup) -> frame plus mean and, where it
has them, q10, q50, q90``. ``history`` is the 5-minute grid (key, slot, queue) and
``frame`` has one row per (key, origin, horizon) with its target.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..constants import BACKTEST_HORIZONS_H, FEATURE_STEP, KEY, LOCAL_TZ, PREDICTOR_LEVELS, VALUE
from ..functions.calendar import as_ts, floor_to, micros, resolved, slot_parts, to_local
from ..functions.numbers import non_crossing, quantile_name
from ..operators.asof import asof_nearest, neighbours
from ..operators.profiles import profiles_asof
from ..session import materialise
from ..operators.scoring import score_predictions, summarise_backtest

HOUR_US = 3_600_000_000


@dataclass(frozen=True)
class Setup:
    """When to forecast from, how far, and what a fitted predictor may look at."""

    as_of: object
    backtest_days: int = 30
    origin_every_hours: int = 6
    horizons_h: list[int] = field(default_factory=lambda: list(BACKTEST_HORIZONS_H))
    train_days: int = 120
    refit_hours: int = 24
    min_train_rows: int = 500
    spare_days: int = 8

    def resolved(self, spark) -> Setup:
        return replace(self, as_of=resolved(spark, self.as_of))

    @property
    def last_origin(self) -> Column:
        return floor_to(as_ts(self.as_of), FEATURE_STEP) - F.expr(f"INTERVAL '{max(self.horizons_h)}' HOUR")

    @property
    def first_origin(self) -> Column:
        return self.last_origin - F.expr(f"INTERVAL '{self.backtest_days}' DAY")


Predictor = Callable[[DataFrame, DataFrame, Setup], DataFrame]


def backtest_frame(keys: DataFrame, setup: Setup) -> DataFrame:
    """Every key with every origin and horizon, and the target moment."""
    origins = F.sequence(setup.first_origin, setup.last_origin, F.expr(f"INTERVAL '{setup.origin_every_hours}' HOUR"))
    return (keys.select(KEY).distinct()
            .withColumn("origin", F.explode(origins))
            .withColumn("horizon_h", F.explode(F.array(*map(F.lit, setup.horizons_h))))
            .withColumn("target", F.col("origin") + F.col("horizon_h") * F.expr("INTERVAL '1' HOUR")))


def last_at_origin(history: DataFrame, frame: DataFrame, setup: Setup) -> DataFrame:
    """``last_value`` per (key, origin): the newest reading at or before the origin.

    History is reduced to one row per (key, first origin at or after it); the
    window then runs over origins, not over history.
    """
    width = F.lit(setup.origin_every_hours * HOUR_US)

    def number(ts) -> Column:
        return F.greatest(F.ceil((micros(ts) - micros(setup.first_origin)) / width), F.lit(0)).cast("int")

    newest = history.groupBy(KEY, number("slot").alias("_o")).agg(F.max_by(VALUE, "slot").alias("_v"))
    asked = frame.select(KEY, "origin").distinct().withColumn("_o", number("origin"))
    w = W.partitionBy(KEY).orderBy("_o").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = (newest.unionByName(asked, allowMissingColumns=True)
            .groupBy(KEY, "_o").agg(F.max("_v").alias("_v"), F.max("origin").alias("origin")))
    return (both.withColumn("last_value", F.last("_v", ignorenulls=True).over(w))
            .where(F.col("origin").isNotNull()).select(KEY, "origin", "last_value"))


def last_value(history: DataFrame, frame: DataFrame, setup: Setup) -> DataFrame:
    return (frame.join(last_at_origin(history, frame, setup), [KEY, "origin"], "left")
            .withColumnRenamed("last_value", "mean"))


def seasonal_naive(history: DataFrame, frame: DataFrame, setup: Setup, within_min: int = 30) -> DataFrame:
    """Nearest reading a week before the target, none of it after the origin; else the last value."""
    asked = frame.withColumn("_week", F.col("target") - F.expr("INTERVAL '7' DAY"))
    hits = neighbours(asked, history, [VALUE], target_ts="_week", sample_ts="slot")
    tol, known = within_min * 60_000_000, micros("origin")
    behind, beyond = F.col("us") - F.col("prev.us"), F.col("next.us") - F.col("us")
    prev_ok = (behind <= tol) & (F.col("prev.us") <= known)
    next_ok = (beyond <= tol) & (F.col("next.us") <= known)
    pick = (F.when(next_ok & (~F.coalesce(prev_ok, F.lit(False)) | (beyond <= behind)), F.col(f"next.{VALUE}"))
            .when(prev_ok, F.col(f"prev.{VALUE}")))
    out = asked.withColumn("us", micros("_week")).join(hits, [KEY, "us"], "left").withColumn("_v", pick)
    return (out.drop("us", "prev", "next", "_week")
            .join(last_at_origin(history, frame, setup), [KEY, "origin"], "left")
            .withColumn("mean", F.coalesce("_v", "last_value")).drop("_v", "last_value"))


def calendar_profile(history: DataFrame, frame: DataFrame, setup: Setup) -> DataFrame:
    """Seasonal mean known at the origin as point forecast."""
    return (profiles_asof(history, frame, setup.first_origin, setup.origin_every_hours, LOCAL_TZ, FEATURE_STEP)
            .withColumn("mean", F.col("profile_dow_time")).drop("profile_dow_time", "profile_time"))


def _since_first(ts, setup: Setup) -> Column:
    """Origins between the first one and ``ts``, with a fraction."""
    return (micros(ts) - micros(setup.first_origin)) / F.lit(setup.origin_every_hours * HOUR_US)


def _training_origins(ts, setup: Setup) -> tuple[Column, Column]:
    """The first origin whose training span holds ``ts``, and the first one after it that does not."""
    end = F.col(ts) + F.expr(f"INTERVAL '{setup.train_days}' DAY")
    return (F.greatest(F.ceil(_since_first(ts, setup)), F.lit(0)).cast("int"),
            (F.floor(_since_first(end, setup)) + 1).cast("int"))


def _last_number(setup: Setup) -> Column:
    return F.floor(_since_first(setup.last_origin, setup)).cast("int")


def _training_sizes(rows: DataFrame, setup: Setup) -> DataFrame:
    """Training rows of all keys per origin number.

    A row counts from origin ``_in`` until ``_out``, so it is one step up and one step
    down; the running sum of the steps is the size. The window holds one row per origin.
    """
    steps = (rows.groupBy("_in", "_out").agg(F.count(F.lit(1)).alias("n"))
             .select(F.explode(F.array(F.struct(F.col("_in").alias("_no"), F.col("n").alias("d")),
                                       F.struct(F.col("_out").alias("_no"), (-F.col("n")).alias("d")))).alias("s"))
             .groupBy("s._no").agg(F.sum("s.d").alias("d")))
    last = _last_number(setup)
    origins = steps.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), last)).alias("_no"), F.lit(0).alias("d"))
    run = W.orderBy("_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (steps.unionByName(origins).groupBy("_no").agg(F.sum("d").alias("d"))
            .select("_no", F.sum("d").over(run).alias("_size")).where(F.col("_no") <= last))


def fit_numbers(sizes: list[int], origin_every_hours: int, refit_hours: int, min_rows: int) -> list[int | None]:
    """For each origin in order the origin whose fit it uses, or None.

    A fit is made at the first origin at least ``refit_hours`` after the last one; an
    attempt with fewer than ``min_rows`` rows predicts nothing and is repeated at the
    next origin.
    """
    last, out = None, []
    for no, size in enumerate(sizes):
        if last is None or (no - last) * origin_every_hours >= refit_hours:
            if size < min_rows:
                out.append(None)
                continue
            last = no
        out.append(last)
    return out


def _fits(rows: DataFrame, setup: Setup) -> Column:
    """A map from origin number to the number of its fit; one row per origin passes the driver."""
    sizes = _training_sizes(rows, setup).orderBy("_no").collect()
    numbers = fit_numbers([r["_size"] for r in sizes], setup.origin_every_hours, setup.refit_hours, setup.min_train_rows)
    return F.get(F.array(*[F.lit(n) for n in numbers]).cast("array<int>"), F.col("_no"))


def _counted_values(rows: DataFrame, cell: list[str]) -> DataFrame:
    """How often each cell sees a value from one origin until another.

    ``rows`` are seen from origin ``_in`` up to, not including, ``_out``: a step up and a
    step down in the count of (cell, value). Equal steps add up, and the running sum over
    the origins is the count, constant from one step to the next.
    """
    edges = F.explode(F.array(F.struct(F.col("_in").alias("at"), F.lit(1).alias("d")),
                              F.struct(F.col("_out").alias("at"), F.lit(-1).alias("d"))))
    steps = rows.select(*cell, VALUE, edges.alias("e")).groupBy(*cell, VALUE, F.col("e.at").alias("_at")).agg(F.sum("e.d").alias("_d"))
    w = W.partitionBy(*cell, VALUE).orderBy("_at")
    return (steps.withColumns({"_n": F.sum("_d").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)),
                               "_until": F.lead("_at").over(w)})
            .where(F.col("_n") > 0).drop("_d"))


def _quantiles_at(rows: DataFrame, asked: DataFrame, cell: list[str], levels: list[float]) -> DataFrame:
    """(cell, _fit_no, _q): exact quantiles of the values that each asked fit sees in its cell.

    A cell's asked fits come as one row, so a count meets it once and is repeated for the
    fits it holds for, no other. The quantiles are taken of values with their counts: a
    fit costs the distinct values it sees.
    """
    fits = asked.groupBy(*cell).agg(F.array_sort(F.collect_set("_fit_no")).alias("_fits"))
    seen = _counted_values(rows.join(fits.select(*cell), cell, "left_semi"), cell).join(fits, cell)
    holds = F.filter("_fits", lambda f: (f >= F.col("_at")) & (f < F.col("_until")))
    return (seen.select(*cell, VALUE, "_n", F.explode(holds).alias("_fit_no"))
            .groupBy(*cell, "_fit_no").agg(F.percentile(VALUE, F.array(*map(F.lit, levels)), F.col("_n")).alias("_q")))


def calendar_quantiles(history: DataFrame, frame: DataFrame, setup: Setup,
                       levels: list[float] = PREDICTOR_LEVELS) -> DataFrame:
    """Quantile profiles refitted at most every ``refit_hours`` on the last ``train_days``.

    Fits are made at origins, see :func:`fit_numbers`. A level is only computed for the
    cells that are asked for, and a coarser level only for requests the finer one could
    not answer. Nothing is predicted from a fit with fewer than ``min_train_rows`` rows.
    """
    setup = setup.resolved(history.sparkSession)
    own = slot_parts(to_local("slot", LOCAL_TZ), FEATURE_STEP)
    enter, leave = _training_origins("slot", setup)
    rows = history.select(KEY, VALUE, enter.alias("_in"), leave.alias("_out"), *[
        c.alias(f"_{p[0]}") for p, c in own.items()]).where((F.col("_out") > 0) & (F.col("_in") <= _last_number(setup)))
    parts = slot_parts(to_local("target", LOCAL_TZ), FEATURE_STEP)
    no = F.round(_since_first("origin", setup)).cast("int")
    asked = frame.withColumns({"_no": no, **{f"_{p[0]}": c for p, c in parts.items()}})
    asked = asked.withColumn("_fit_no", _fits(rows, setup)).drop("_no").where(F.col("_fit_no").isNotNull())

    out = asked
    for depth, cell in enumerate(([KEY, "_w", "_h", "_m"], [KEY, "_h", "_m"], [KEY])):
        open_ = out if depth == 0 else out.where(F.col("_q").isNull())
        quantiles = _quantiles_at(rows, open_, cell, levels).withColumnRenamed("_q", "_found")
        out = out.join(quantiles, [*cell, "_fit_no"], "left")
        # Written, as the next level asks for what is open and keeps the rest; as small as the frame.
        out = materialise(out.withColumn("_q", F.coalesce("_q", "_found") if depth else F.col("_found")).drop("_found"), "fitted")
        if out.where(F.col("_q").isNull()).isEmpty():
            break
    out = out.where(F.col("_q").isNotNull())
    names = [quantile_name(q) for q in levels]
    bands = non_crossing([F.get("_q", F.lit(i)) for i in range(len(levels))])
    return (out.withColumns(dict(zip(names, bands))).withColumn("mean", F.col(quantile_name(0.5)))
            .drop("_q", "_fit_no", "_w", "_h", "_m"))


PREDICTORS: dict[str, Predictor] = {
    "last_value": last_value,
    "seasonal_naive": seasonal_naive,
    "calendar": calendar_quantiles,
}


def register_predictor(name: str, predictor: Predictor) -> None:
    """Make a predictor known to :func:`run_backtest`."""
    PREDICTORS[name] = predictor


def backtest_scores(history: DataFrame, setup: Setup, predictors: dict[str, Predictor] | None = None) -> DataFrame:
    """One scored row per prediction that has an actual within five minutes of its target.

    The history is bounded to what the setup can look at: the backtest's days, the training
    span, and ``setup.spare_days`` for a week back. The history and the frame with its
    actuals feed every predictor, so both are written to the shared folder first.
    """
    setup = setup.resolved(history.sparkSession)
    days = setup.backtest_days + setup.train_days + setup.spare_days
    since = floor_to(as_ts(setup.as_of), FEATURE_STEP) - F.expr(f"INTERVAL '{days}' DAY")
    history = materialise(history.where(F.col("slot") >= since), "history")
    frame = backtest_frame(history, setup)
    known = asof_nearest(frame, history, [VALUE], within_min=5, target_ts="target", sample_ts="slot")
    known = materialise(known.withColumnRenamed(VALUE, "y").where(F.col("y").isNotNull()), "actuals")
    quantiles = [quantile_name(q) for q in PREDICTOR_LEVELS]
    scored = None
    for name, predict in (predictors or PREDICTORS).items():
        out = predict(history, known, setup)
        for q in quantiles:
            if q not in out.columns:
                out = out.withColumn(q, F.lit(None).cast("double"))
        out = out.select(F.lit(name).alias("model"), KEY, "origin", "horizon_h", "target", "y", "mean", *quantiles)
        scored = out if scored is None else scored.unionByName(out)
    return score_predictions(scored)


def run_backtest(history: DataFrame, setup: Setup, predictors: dict[str, Predictor] | None = None) -> DataFrame:
    return summarise_backtest(backtest_scores(history, setup, predictors))
