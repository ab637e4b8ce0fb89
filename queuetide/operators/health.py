"""Pull health: counts, rates, duration histogram, gauges, status table, freshness."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..constants import DURATION_BOUNDS, KEY, MIN_HORIZON_MIN, TS, VALUE
from ..functions.calendar import as_ts, minutes_between, minutes_remaining, moment_key


def succeeded():
    """A pull that came back without a value (``skipped``) counts as a success, too."""
    return F.col("status").isin("success", "skipped")


def pull_counts(pulls: DataFrame) -> DataFrame:
    return pulls.groupBy(KEY, "status").agg(F.count(F.lit(1)).alias("pulls"))


def pull_counts_wide(pulls: DataFrame) -> DataFrame:
    return pulls.groupBy(KEY).agg(
        F.count_if(succeeded()).alias("successes"),
        F.count_if(F.col("status") == "failure").alias("failures"))


def windowed_pulls(pulls: DataFrame, minutes: int, step: int = 5) -> DataFrame:
    """Successes, failures and rate per key over the trailing window, every ``step`` minutes.

    Rows are summed per step first; only those sums are spread over the windows
    they fall in. A row stands for the window ``[end - minutes, end)``.
    """
    per_step = (pulls.groupBy(KEY, F.window(TS, f"{step} minutes").alias("_s")).agg(
        F.count_if(succeeded()).alias("ok"), F.count_if(F.col("status") == "failure").alias("bad"))
        .select(KEY, F.col("_s.start").alias("_at"), "ok", "bad"))
    out = (per_step.groupBy(KEY, F.window("_at", f"{minutes} minutes", f"{step} minutes").alias("_w"))
           .agg(F.sum("ok").alias("successes"), F.sum("bad").alias("failures")))
    rate = F.when(F.col("successes") + F.col("failures") > 0,
                  F.col("successes") / (F.col("successes") + F.col("failures")))
    return out.select(KEY, F.col("_w.end").alias("at"), "successes", "failures", rate.alias("success_rate"))


def success_rate(pulls: DataFrame, minutes: int = 10, step: int = 5) -> DataFrame:
    return windowed_pulls(pulls, minutes, step).select(KEY, "at", "success_rate")


def failures_increase(pulls: DataFrame, minutes: int = 60, step: int = 5) -> DataFrame:
    return windowed_pulls(pulls, minutes, step).select(KEY, "at", "failures", "successes")


def _label(bound: float) -> str:
    return f"le_{bound:g}".replace(".", "_")


def duration_histogram(pulls: DataFrame, by: list | None = None) -> DataFrame:
    """Cumulative counts per upper bound; ``le_inf`` counts all."""
    d = F.col("duration_s")
    return pulls.groupBy(*(by or [KEY])).agg(
        *[F.count_if(d <= b).alias(_label(b)) for b in DURATION_BOUNDS],
        F.count(d).alias("le_inf"), F.sum(d).alias("duration_sum"))


def histogram_quantile(hist: DataFrame, levels: list[float] | None = None) -> DataFrame:
    """Quantiles read off the cumulative counts, linear inside a bucket.

    The first bucket starts at zero; a rank in the last, open one gives the highest
    finite bound.
    """
    rising = [F.col(_label(b)) for b in DURATION_BOUNDS]

    def estimate(level: float) -> Column:
        rank = F.lit(level) * F.col("le_inf")
        out = None
        for i, bound in enumerate(DURATION_BOUNDS):
            low = DURATION_BOUNDS[i - 1] if i else 0.0
            under = rising[i - 1] if i else F.lit(0)
            inside = F.lit(low) + (bound - low) * (rank - under) / F.nullif(rising[i] - under, F.lit(0))
            out = F.when(rising[i] >= rank, inside) if out is None else out.when(rising[i] >= rank, inside)
        return F.when(F.col("le_inf") > 0, out.otherwise(DURATION_BOUNDS[-1]))

    return hist.withColumns({f"p{int(round(q * 100))}": estimate(q) for q in (levels or [0.5, 0.95, 0.99])})


def duration_quantiles(pulls: DataFrame, minutes: int = 10, step: int = 5) -> DataFrame:
    """p50/p95/p99 of the trailing window per key, every ``step`` minutes."""
    per_step = duration_histogram(pulls, [KEY, F.window(TS, f"{step} minutes").alias("_s")])
    labels = [_label(b) for b in DURATION_BOUNDS] + ["le_inf"]
    rolled = (per_step.withColumn("_at", F.col("_s.start"))
              .groupBy(KEY, F.window("_at", f"{minutes} minutes", f"{step} minutes").alias("_w"))
              .agg(*[F.sum(c).alias(c) for c in labels]).withColumn("at", F.col("_w.end")).drop("_w"))
    return histogram_quantile(rolled).select(KEY, "at", "p50", "p95", "p99")


def exact_duration_quantiles(pulls: DataFrame, unit_s: float = 0.001) -> DataFrame:
    """Exact p50/p95/p99 per key.

    Counts per (key, unit of duration) find the units the ranks fall in; only the
    durations of those units are counted and ranked. No key is gathered whole.
    """
    levels = (0.5, 0.95, 0.99)
    known = pulls.where(F.col("duration_s").isNotNull()).withColumn(
        "_u", F.floor(F.col("duration_s") / unit_s).cast("bigint"))
    by_unit = W.partitionBy(KEY).orderBy("_u")
    units = known.groupBy(KEY, "_u").agg(F.count(F.lit(1)).alias("_n")).select(
        KEY, "_u", "_n", (F.sum("_n").over(by_unit) - F.col("_n")).alias("_before"),
        F.sum("_n").over(W.partitionBy(KEY)).alias("_total"))
    rank = {q: F.lit(q) * (F.col("_total") - 1) for q in levels}
    ends = [end for r in rank.values() for end in (F.floor(r), F.ceil(r))]
    holds = [(F.col("_before") <= e) & (e < F.col("_before") + F.col("_n")) for e in ends]
    wanted = units.where(reduce(or_, holds)).drop("_n")
    counts = (known.join(wanted.select(KEY, "_u"), [KEY, "_u"], "left_semi")
              .groupBy(KEY, "_u", "duration_s").agg(F.count(F.lit(1)).alias("n")))
    inside = W.partitionBy(KEY, "_u").orderBy("duration_s")
    placed = counts.join(wanted, [KEY, "_u"]).withColumn("_upto", F.col("_before") + F.sum("n").over(inside))
    aggs = []
    for q in levels:
        low = F.min(F.when(F.col("_upto") > F.floor(rank[q]), F.col("duration_s")))
        high = F.min(F.when(F.col("_upto") > F.ceil(rank[q]), F.col("duration_s")))
        part = F.max(rank[q] - F.floor(rank[q]))
        aggs.append((low + (high - low) * part).alias(f"p{int(round(q * 100))}"))
    return placed.groupBy(KEY).agg(*aggs)


def last_value_gauges(pulls: DataFrame, as_of) -> DataFrame:
    """Latest queue, last successful pull, and minutes since it."""
    ok = F.col("status") == "success"
    out = pulls.groupBy(KEY).agg(
        F.max_by(VALUE, F.when(ok, moment_key(TS, "pull_id"))).alias(VALUE),
        F.max(F.when(ok, F.col(TS))).alias("last_pull"))
    return out.withColumn("minutes_since_pull", minutes_between(as_ts(as_of), "last_pull"))


def status_table(pulls: DataFrame, as_of) -> DataFrame:
    """Queue, minutes since the last pull, successes and failures of the last hour, in one pass.

    A key shows up when at least one of the four is known, as in a full join of the
    four metrics; a count of nothing is NULL.
    """
    now, ok = as_ts(as_of), F.col("status") == "success"
    hour = (F.col(TS) > now - F.expr("INTERVAL '1' HOUR")) & (F.col(TS) <= now)
    out = pulls.groupBy(KEY).agg(
        F.max_by(VALUE, F.when(ok, moment_key(TS, "pull_id"))).alias(VALUE),
        minutes_between(now, F.max(F.when(ok, F.col(TS)))).alias("minutes_since_pull"),
        F.nullif(F.count_if(hour & ok), F.lit(0)).alias("successes_1h"),
        F.nullif(F.count_if(hour & (F.col("status") == "failure")), F.lit(0)).alias("failures_1h"))
    known = [F.col(c).isNotNull() for c in out.columns if c != KEY]
    return out.where(known[0] | known[1] | known[2] | known[3])


def merge_metrics(*frames: DataFrame) -> DataFrame:
    """Per-key frames from different sources in one table; a key of any of them keeps its row."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.join(frame, KEY, "full")
    return out


def forecast_freshness(forecasts: DataFrame, stats: DataFrame, as_of, keys: DataFrame | None = None,
                       min_minutes: int = MIN_HORIZON_MIN) -> DataFrame:
    """Per key: is there a forecast, how many minutes of it are left, and the prep status.

    Records without a mean are placeholders and do not count.
    """
    last = forecasts.where(F.col("mean").isNotNull()).groupBy(KEY).agg(F.max(TS).alias("_last"))
    base = (stats.select(KEY) if keys is None else keys.select(KEY)).distinct()
    return (base.join(stats.select(KEY, "status", "context_age_minutes", "context_synthetic_ratio"), KEY, "left")
            .join(last, KEY, "left")
            .withColumns({
                "has_forecast": F.col("_last").isNotNull(),
                "horizon_remaining_minutes": minutes_remaining("_last", as_of),
                "usable": F.coalesce(minutes_between("_last", as_ts(as_of)) >= min_minutes, F.lit(False)),
            }).drop("_last"))


def service_health(freshness: DataFrame, forecasts: DataFrame, min_minutes: int = MIN_HORIZON_MIN) -> DataFrame:
    """One row: ok while at least one key's forecast still reaches far enough."""
    loaded = forecasts.agg(F.count_distinct(KEY)).scalar()
    return (freshness.agg(F.count_if("usable").alias("airports_usable"))
            .withColumns({"airports_loaded": loaded, "min_future_horizon_minutes": F.lit(min_minutes),
                          "status": F.when(F.col("airports_usable") > 0, "ok").otherwise("stale")}))
