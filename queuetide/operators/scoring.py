"""Scores of predictions, backtest summaries, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..constants import MODEL_ORDER, PREDICTOR_LEVELS
from ..functions.numbers import pinball, quantile_name


def score_predictions(df: DataFrame, y: str = "y", levels: list[float] = PREDICTOR_LEVELS) -> DataFrame:
    """Errors per row, and the mean pinball loss of the quantiles that exist."""
    losses = F.filter(F.array(*[pinball(y, quantile_name(q), q) for q in levels]), lambda v: v.isNotNull())
    total = F.aggregate(losses, F.lit(0.0), lambda acc, v: acc + v)
    err = F.col(y) - F.col("mean")
    return (df.where(F.col(y).isNotNull() & F.col("mean").isNotNull())
            .withColumns({"abs_err": F.abs(err), "sq_err": err * err, "abs_y": F.abs(F.col(y)),
                          "q_loss": F.when(F.size(losses) > 0, total / F.size(losses))}))


def summarise_backtest(scores: DataFrame) -> DataFrame:
    """n, mae, rmse and wql per (model, horizon) and, with horizon ``ALL``, per model."""
    scale = F.avg("abs_y")
    return (scores.groupingSets([[F.col("model"), F.col("horizon_h")], [F.col("model")]], "model", "horizon_h")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("abs_err").alias("mae"),
                 F.sqrt(F.avg("sq_err")).alias("rmse"),
                 F.when(scale != 0, 2.0 * F.avg("q_loss") / scale).alias("wql"),
                 F.grouping("horizon_h").alias("_all"))
            .withColumn("horizon", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("horizon_h").cast("string")))
            .drop("_all", "horizon_h"))


def model_rank(model: str = "model", order: list[str] = MODEL_ORDER) -> Column:
    """Place in the listing; unknown models go last."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(model))
    return F.when(at > 0, (at - 1).cast("int")).otherwise(99)


def ranked(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.try_to_number("horizon", F.lit("999999")).asc_nulls_first(), model_rank(), "model")


def holdout_metrics(predictions: DataFrame, levels: list[float] = PREDICTOR_LEVELS, y: str = "y") -> DataFrame:
    """MAE, RMSE, pinball per level and their mean over mean |y| (no factor two)."""
    levels = sorted(levels)
    point = quantile_name(0.5 if 0.5 in levels else levels[len(levels) // 2])
    err = F.col(y) - F.col(point)
    out = predictions.agg(
        F.count(F.lit(1)).alias("n_valid"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(F.col(y))).alias("_scale"),
        *[F.avg(pinball(y, quantile_name(q), q)).alias(f"pinball_{quantile_name(q)}") for q in levels])
    mean_loss = sum((F.col(f"pinball_{quantile_name(q)}") for q in levels), F.lit(0.0)) / len(levels)
    scale = F.when(F.col("_scale") == 0, 1.0).otherwise(F.col("_scale"))
    return out.withColumn("wql_holdout", mean_loss / scale).drop("_scale")


def drift(history: DataFrame) -> DataFrame:
    """Change of the overall scores against the model's previous run."""
    w = W.partitionBy("model").orderBy("generated_at")
    return history.withColumns({f"{m}_change": F.col(m) - F.lag(m).over(w) for m in ("mae", "rmse", "wql")})
