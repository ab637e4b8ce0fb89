"""Predictors: calendar features, quantile profiles, boosted trees, flat fallback.

A model here is a function ``requests -> requests plus q10, q50, q90``, with
``requests`` holding (key, timestamp).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import (FEATURE_COLUMNS, FEATURE_STEP, FORECAST_KEYS, HOLDOUT_DAYS, MAX_ROUNDS, TRAIN_DAYS, KEY, LOCAL_TZ,
                         PREDICTOR_LEVELS, TS, VALUE)
from ..functions.calendar import calendar_features, cyclical_features, slot_parts, to_local
from ..functions.numbers import categorical_code, non_crossing, quantile_name
from ..operators.latest import holiday_flag
from ..operators.profiles import Profiles, build_profiles, profile_lookup
from ..session import materialise


def feature_frame(df: DataFrame, profiles: Profiles, holidays: DataFrame, vocabulary: list[str] | None = None,
                  ts: str = TS) -> DataFrame:
    """The 15 calendar and profile features and the key's category code."""
    out = cyclical_features(calendar_features(df, ts), ts)
    out = out.withColumn("_date", F.to_date(to_local(ts, LOCAL_TZ)))
    out = holiday_flag(out, holidays, date="_date").drop("_date")
    out = profile_lookup(out, profiles, ts)
    return out.withColumn("airport_code", categorical_code(KEY, vocabulary or FORECAST_KEYS))


def training_frame(grid: DataFrame, profiles: Profiles, holidays: DataFrame,
                   vocabulary: list[str] | None = None) -> DataFrame:
    """Features, category code and target for every gridded observation."""
    out = feature_frame(grid.withColumnRenamed("slot", TS), profiles, holidays, vocabulary)
    return out.select(KEY, TS, *FEATURE_COLUMNS, "airport_code", F.col(VALUE).alias("y"))


def time_split(grid: DataFrame, holdout_days: int = HOLDOUT_DAYS, ts: str = "slot") -> tuple[DataFrame, DataFrame]:
    """Train and holdout parts around one cutoff, set by the newest row of all keys."""
    cutoff = grid.agg(F.max(ts)).scalar() - F.expr(f"INTERVAL '{holdout_days}' DAY")
    return grid.where(F.col(ts) < cutoff), grid.where(F.col(ts) >= cutoff)


@dataclass(frozen=True)
class QuantileProfiles:
    """Exact quantiles per slot, per time of day and per key, as small tables."""

    slots: DataFrame
    times: DataFrame
    overall: DataFrame
    tz: str
    bucket: int
    levels: tuple[float, ...]

    def save(self, path: str) -> None:
        """Write the tables and the settings."""
        self.slots.write.mode("overwrite").parquet(f"{path}/slots")
        self.times.write.mode("overwrite").parquet(f"{path}/times")
        self.overall.write.mode("overwrite").parquet(f"{path}/overall")
        (self.overall.sparkSession.range(1).select(
            F.lit(self.tz).alias("tz"), F.lit(self.bucket).alias("bucket"),
            F.array(*map(F.lit, self.levels)).alias("levels")).write.mode("overwrite").parquet(f"{path}/settings"))

    @staticmethod
    def load(spark: SparkSession, path: str) -> QuantileProfiles:
        settings = spark.read.parquet(f"{path}/settings").first()
        slots, times, overall = (spark.read.parquet(f"{path}/{t}") for t in ("slots", "times", "overall"))
        return QuantileProfiles(slots, times, overall, settings["tz"], settings["bucket"], tuple(settings["levels"]))

    def predict(self, requests: DataFrame, ts: str = TS) -> DataFrame:
        """Quantiles from the finest level that has data; unknown keys get 0."""
        parts = slot_parts(to_local(ts, self.tz), self.bucket)
        out = (requests.withColumns({"_w": parts["weekday"], "_h": parts["hour"], "_m": parts["minute"]})
               .join(self.slots, [KEY, "_w", "_h", "_m"], "left")
               .join(self.times, [KEY, "_h", "_m"], "left")
               .join(self.overall, KEY, "left"))
        zero = F.array(*[F.lit(0.0)] * len(self.levels))
        best = F.coalesce("_slot", "_time", "_all", zero)
        out = out.withColumn("_q", best)
        names = [quantile_name(q) for q in self.levels]
        bands = non_crossing([F.get("_q", F.lit(i)) for i in range(len(names))])
        return (out.withColumns(dict(zip(names, bands)))
                .drop("_w", "_h", "_m", "_slot", "_time", "_all", "_q"))


def quantile_profile_model(grid: DataFrame, tz: str = LOCAL_TZ, bucket: int = FEATURE_STEP,
                           levels: list[float] = PREDICTOR_LEVELS) -> QuantileProfiles:
    """Exact empirical quantiles of gridded history.

    The grid is read once, to count each value per cell; these counts are written to the
    shared folder and all levels take weighted percentiles of them. A percentile buffer
    holds the distinct values of one key at most, and raw rows never reach it.
    """
    parts = slot_parts(to_local("slot", tz), bucket)
    cells = [parts[p].alias(f"_{p[0]}") for p in ("weekday", "hour", "minute")]
    counts = materialise(grid.groupBy(KEY, *cells, VALUE).agg(F.count(F.lit(1)).alias("_n")), "counts")
    wanted = F.array(*map(F.lit, levels))

    def level(name: str, *cells: str) -> DataFrame:
        values = counts.groupBy(KEY, *cells, VALUE).agg(F.sum("_n").alias("_n"))
        return values.groupBy(KEY, *cells).agg(F.percentile(VALUE, wanted, F.col("_n")).alias(name))

    return QuantileProfiles(level("_slot", "_w", "_h", "_m"), level("_time", "_h", "_m"), level("_all"),
                            tz, bucket, tuple(levels))


def constant_model(requests: DataFrame, value: float = 5.0, levels: list[float] = PREDICTOR_LEVELS) -> DataFrame:
    """The same value for every quantile, until a model exists."""
    return requests.withColumns({quantile_name(q): F.lit(float(value)) for q in levels})


@dataclass(frozen=True)
class BoostedCalendar:
    """Boosted trees for the median and residual quantiles for the band."""

    trees: PipelineModel
    residuals: DataFrame
    profiles: Profiles
    holidays: DataFrame
    vocabulary: list[str]
    metrics: DataFrame

    def save(self, path: str) -> None:
        self.trees.write().overwrite().save(f"{path}/trees")
        tables = {"residuals": self.residuals, "holidays": self.holidays, "metrics": self.metrics,
                  "times": self.profiles.times, "overall": self.profiles.overall}
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        (self.residuals.sparkSession.range(1).select(
            F.lit(self.profiles.tz).alias("tz"), F.lit(self.profiles.bucket).alias("bucket"),
            F.array(*map(F.lit, self.vocabulary)).alias("vocabulary"))
         .write.mode("overwrite").parquet(f"{path}/settings"))

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedCalendar:
        settings = spark.read.parquet(f"{path}/settings").first()
        t = {n: spark.read.parquet(f"{path}/{n}") for n in ("residuals", "holidays", "metrics", "times", "overall")}
        profiles = Profiles(t["times"], t["overall"], settings["tz"], settings["bucket"])
        return BoostedCalendar(PipelineModel.load(f"{path}/trees"), t["residuals"], profiles, t["holidays"],
                               list(settings["vocabulary"]), t["metrics"])

    def predict(self, requests: DataFrame, ts: str = TS) -> DataFrame:
        feats = feature_frame(requests, self.profiles, self.holidays, self.vocabulary, ts)
        return _with_band(_point(self.trees, feats, self.vocabulary), self.residuals).select(*requests.columns, "q10", "q50", "q90")


def _inputs() -> list[str]:
    return [*FEATURE_COLUMNS, "_code"]


def _coded(feats: DataFrame, vocabulary: list[str]) -> DataFrame:
    """The key's code as a nominal feature; an unknown key gets its own, past the vocabulary."""
    nominal = {"ml_attr": {"type": "nominal", "num_vals": len(vocabulary) + 1}}
    code = F.coalesce(F.col("airport_code").cast("double"), F.lit(float(len(vocabulary))))
    return feats.select("*", code.alias("_code", metadata=nominal))


def _point(trees: PipelineModel, feats: DataFrame, vocabulary: list[str]) -> DataFrame:
    return trees.transform(_coded(feats, vocabulary)).withColumnRenamed("prediction", "_p50")


LEAST_RESIDUALS = 9  # below it the outer tenths of a group lie outside its residuals


def _tenths(residuals: Column) -> Column:
    """The residuals at rank n + 1 times a tenth and nine tenths, between neighbours in proportion.

    A new residual that is exchangeable with these falls between the two with a chance of
    80 %, whatever their number (split conformal); percentiles of a few are too narrow.
    """
    def at(share: float) -> Column:
        rank = F.lit(share) * (F.size(residuals) + 1)
        low = F.floor(rank).cast("int")
        below = F.get(residuals, low - 1)
        return below + (rank - low) * (F.coalesce(F.get(residuals, low), below) - below)

    return F.array(at(0.1), at(0.9))


def _residuals(scored: DataFrame) -> DataFrame:
    """The band around the median per (key, hour), for keys as a whole (hour null), and for all (both null).

    Groups hold the calibration part's slots, so their lists are bounded by its days; the
    coarsest level is an exact percentile of all. Groups too small for a tenth are left out.
    """
    r = F.col("y") - F.col("_p50")
    parts = [scored.groupBy(*cell).agg(F.sort_array(F.collect_list(r)).alias("_all")).where(F.size("_all") >= LEAST_RESIDUALS)
             .select(*cell, _tenths(F.col("_all")).alias("_r")) for cell in ([KEY, "hour"], [KEY])]
    parts.append(scored.agg(F.percentile(r, F.array(F.lit(0.1), F.lit(0.9))).alias("_r")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def _with_band(points: DataFrame, residuals: DataFrame) -> DataFrame:
    by_hour = residuals.where(F.col("hour").isNotNull())
    by_key = residuals.where(F.col("hour").isNull() & F.col(KEY).isNotNull()).select(KEY, F.col("_r").alias("_k"))
    overall = residuals.where(F.col(KEY).isNull()).select("_r").first()  # one row
    rest = F.lit(list(overall["_r"])) if overall and overall["_r"] else F.lit(None).cast("array<double>")
    out = points.join(by_hour, [KEY, "hour"], "left").join(by_key, KEY, "left")
    band = F.coalesce("_r", "_k", rest)
    low = F.col("_p50") + F.coalesce(F.get(band, F.lit(0)), F.lit(0.0))
    high = F.col("_p50") + F.coalesce(F.get(band, F.lit(1)), F.lit(0.0))
    bands = non_crossing([low, F.col("_p50"), high])
    return out.withColumns(dict(zip(["q10", "q50", "q90"], bands)))


def gbt_calendar_model(grid: DataFrame, holidays: DataFrame, vocabulary: list[str] | None = None,
                       rounds: int = MAX_ROUNDS, depth: int = 6, holdout_days: int = HOLDOUT_DAYS,
                       seed: int = 7, train_days: int = TRAIN_DAYS, tolerance: float = 1e-3) -> BoostedCalendar:
    """Fit on the last ``train_days`` of all keys at once: a trial on all but the holdout first, then a refit on everything.

    The first half of the holdout stops the trial, as soon as a round gains less than
    ``tolerance`` of its error, and gives the band, conformal residuals by key and hour; the
    second half is only scored, the share of its rows within the band with it.
    The refit makes as many rounds as the trial kept. Runs Spark jobs (two fits). The grid
    and the training rows are written to the shared folder first, as fitting goes over them
    many times.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from ..operators.scoring import holdout_metrics

    vocabulary = vocabulary or FORECAST_KEYS
    newest = grid.agg(F.max("slot")).scalar()
    grid = materialise(grid.where(F.col("slot") >= newest - F.expr(f"INTERVAL '{train_days}' DAY")), "grid")

    def fit(frame: DataFrame, most: int, **stop) -> PipelineModel:
        trees = GBTRegressor(featuresCol="_x", labelCol="y", lossType="absolute", maxIter=most, maxDepth=depth,
                             maxBins=max(32, len(vocabulary) + 1), subsamplingRate=0.8, stepSize=0.1, seed=seed, **stop)
        assemble = VectorAssembler(inputCols=_inputs(), outputCol="_x")
        return Pipeline(stages=[assemble, trees]).fit(_coded(frame, vocabulary))

    train, holdout = time_split(grid, holdout_days)
    early = build_profiles(train, LOCAL_TZ, FEATURE_STEP)
    half = grid.agg(F.max("slot")).scalar() - F.expr(f"INTERVAL '{holdout_days * 12}' HOUR")
    held = F.col(TS) >= grid.agg(F.max("slot")).scalar() - F.expr(f"INTERVAL '{holdout_days}' DAY")
    known = materialise(training_frame(train.unionByName(holdout), early, holidays, vocabulary)
                        .withColumns({"_held": held, "_late": F.col(TS) >= half}), "training")
    trial = fit(known.where("not _late"), rounds, validationIndicatorCol="_held", validationTol=tolerance)
    scored = _point(trial, known.where("_held"), vocabulary)
    residuals = materialise(_residuals(scored.where("not _late")), "residuals")
    judged = materialise(_with_band(scored.where("_late"), residuals), "judged")
    covered = judged.agg(F.avg(((F.col("y") >= F.col("q10")) & (F.col("y") <= F.col("q90"))).cast("double")).alias("coverage"))
    metrics = holdout_metrics(judged).crossJoin(covered)  # one row each

    full = build_profiles(grid, LOCAL_TZ, FEATURE_STEP)
    frame = materialise(training_frame(grid, full, holidays, vocabulary), "training")
    trees = fit(frame, trial.stages[-1].getNumTrees)
    return BoostedCalendar(trees, residuals, full, holidays, vocabulary, metrics)
