"""Forecasts for all keys in one plan, and the records that are published.

A model is a function ``(context, future, levels) -> (key, slot, predictions, quantiles)``
where ``quantiles`` maps a level's text to a value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import FORECAST_LEVELS, HORIZON_STEPS, KEY, TS, VALUE
from ..functions.calendar import as_ts, resolved
from ..functions.numbers import quantile_key, quantile_map, quantile_name
from ..operators.context import Prepared, future_grid, prepare_context

Model = Callable[[DataFrame, DataFrame, list[float]], DataFrame]

# Fixed value: the wording of the message.
NO_PREDICTIONS = "No predictions returned by model"


def naive_forecast(context: DataFrame, future: DataFrame, levels: list[float] = FORECAST_LEVELS) -> DataFrame:
    """Last value carried over the horizon; all quantiles equal it."""
    last = context.groupBy(KEY).agg(F.max_by(VALUE, "slot").alias("predictions"))
    return (future.select(KEY, "slot").join(last, KEY, "left")
            .withColumns({quantile_name(q): F.col("predictions") for q in levels}))


def seasonal_forecast(context: DataFrame, future: DataFrame, levels: list[float] = FORECAST_LEVELS) -> DataFrame:
    """The profile covariate as point forecast; no quantiles."""
    return future.select(KEY, "slot", F.col("queue_avg_dow_time").alias("predictions"))


def format_forecast(predicted: DataFrame, levels: list[float] = FORECAST_LEVELS) -> DataFrame:
    """Published rows: ISO text, point value, and the map of quantiles present.

    The point is ``predictions``, else ``mean``, else the median.
    """
    point = next((F.col(c) for c in ("predictions", "mean", "q50") if c in predicted.columns), F.lit(None))
    given = {q: F.col(quantile_name(q)).cast("double") for q in levels if quantile_name(q) in predicted.columns}
    quantiles = quantile_map(given) if given else F.lit(None).cast("map<string,double>")
    return predicted.select(
        KEY, F.col("slot").alias(TS), F.date_format("slot", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
        point.cast("double").alias("mean"), quantiles.alias("quantiles"))


def forecast_records(prepared: Prepared, as_of, model: Model = naive_forecast, n: int = HORIZON_STEPS,
                     levels: list[float] = FORECAST_LEVELS) -> DataFrame:
    """Published rows of usable keys, and one placeholder row for each other key.

    A usable key that the model leaves out gets a placeholder, too.
    """
    as_of = resolved(prepared.context.sparkSession, as_of)
    rows = format_forecast(model(prepared.context, future_grid(prepared, n), levels), levels)
    usable = prepared.stats.where("status = 'ok'").select(KEY)
    rows = usable.join(rows, KEY, "left")
    missing = F.col(TS).isNull()
    now = as_ts(as_of)
    rows = rows.withColumns({
        "message": F.when(missing, F.concat_ws(": ", KEY, F.lit(NO_PREDICTIONS))),
        "iso": F.when(missing, F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.col("iso")),
        TS: F.coalesce(TS, now)})
    refused = prepared.stats.where("status <> 'ok'").select(
        KEY, as_ts(as_of).alias(TS), F.date_format(as_ts(as_of), "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
        F.concat_ws(": ", KEY, "status_message").alias("message"))
    return rows.unionByName(refused, allowMissingColumns=True)


def forecast_metrics(prepared: Prepared, records: DataFrame) -> DataFrame:
    """Prep statistics of every key with the number of forecast rows it got."""
    counts = records.where(F.col("mean").isNotNull()).groupBy(KEY).agg(F.count(F.lit(1)).alias("future_rows"))
    return prepared.stats.join(counts, KEY, "left").na.fill(0, ["future_rows"]).withColumn(
        "history_rows", F.when(F.col("status") == "ok", F.col("context_rows")).otherwise(0))


def batch_forecast(raw: DataFrame, as_of, model: Model = naive_forecast, keys: DataFrame | None = None,
                   n: int = HORIZON_STEPS, levels: list[float] = FORECAST_LEVELS, **prep) -> DataFrame:
    as_of = resolved(raw.sparkSession, as_of)
    return forecast_records(prepare_context(raw, as_of, keys=keys, **prep), as_of, model, n, levels)


def predictor_as_model(predict: Callable[[DataFrame], DataFrame]) -> Model:
    """Use a predictor (key, timestamp to q10/q50/q90) where a forecast model is asked for."""

    def model(context: DataFrame, future: DataFrame, levels: list[float]) -> DataFrame:
        return predict(future.select(KEY, F.col("slot").alias(TS))).withColumnRenamed(TS, "slot")

    return model


__all__ = ["Model", "batch_forecast", "forecast_metrics", "forecast_records", "format_forecast",
           "naive_forecast", "predictor_as_model", "quantile_key", "seasonal_forecast"]
