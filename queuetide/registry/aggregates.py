"""Aggregations: profiles, scores, pull health, freshness, roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import KEY, TS, VALUE
from ..functions.calendar import shift
from ..functions.numbers import pinball
from ..operators import health, latest, live, scoring
from ..operators.context import future_grid, prepare_context
from ..operators.profiles import profiles_asof, seasonal_profiles
from ..plans.backtest import backtest_frame
from ..sources.observations import latest_moment
from .catalog import query, r6, rounded
from .joins import DAILY, FRAME, G5, G15, WALL, grid5, grid15, setup
from .reading import LOCAL, profile_views
from .tables import table, view, with_views


@query("grid_average_15min", with_views(
    "select airport, slot, round(queue, 6) as queue from grid", "obs", extra=G15))
def grid_quarter(spark, sf):
    return rounded(grid15(spark, sf), VALUE)


@query("grid_average_5min", with_views(
    "select airport, slot, round(queue, 6) as queue from grid", "obs", extra=G5))
def grid_five(spark, sf):
    return rounded(grid5(spark, sf), VALUE)


LEVELS = """
select airport, weekday, hour, minute, round(avg(queue), 9) as mean, count(*) as n,
  case when grouping(weekday) = 0 then 'slot' when grouping(hour) = 0 then 'time' else 'all' end as level
from parts group by grouping sets ((airport, weekday, hour, minute), (airport, hour, minute), (airport))"""


@query("seasonal_profiles_local", with_views(LEVELS, "obs", extra={**G5, **profile_views("grid", LOCAL, 5)}))
def profiles_local(spark, sf):
    return rounded(seasonal_profiles(grid5(spark, sf), "Europe/Copenhagen", 5), "mean", digits=9)


@query("seasonal_profiles_utc", with_views(LEVELS, "obs", extra={**G15, **profile_views("grid", "slot", 1)}))
def profiles_utc(spark, sf):
    return rounded(seasonal_profiles(grid15(spark, sf), None, 1), "mean", digits=9)


def asof_means(frame: str, origin: str = "origin") -> str:
    """SQL for profile means known at each row's origin, by brute force."""
    return f"""
select f.airport, f.origin, f.target,
  avg(g.queue) filter (g.weekday = f.weekday and g.hour = f.hour and g.minute = f.minute) as by_slot,
  avg(g.queue) filter (g.hour = f.hour and g.minute = f.minute) as by_time, avg(g.queue) as by_key
from (select *, cast(isodow(l) - 1 as int) as weekday, cast(hour(l) as int) as hour,
        cast(minute(l) // 5 * 5 as int) as minute
      from (select *, ((target at time zone 'UTC') at time zone 'Europe/Copenhagen') as l from {frame})) f
left join parts g on g.airport = f.airport and g.slot <= f.{origin}
group by all"""


@query("profiles_asof_origin", with_views("""
select airport, origin, horizon_h, target, round(coalesce(by_slot, by_time, by_key, 0.0), 6) as profile_dow_time,
  round(coalesce(by_time, by_key, 0.0), 6) as profile_time
from frame join means using (airport, origin, target)
""", "obs", extra={**G5, **profile_views("grid", LOCAL, 5), **FRAME, "means": asof_means("frame")}))
def profiles_at_origin(spark, sf):
    s, grid = setup(spark, sf), grid5(spark, sf)
    out = profiles_asof(grid, backtest_frame(grid, s), s.first_origin, s.origin_every_hours, "Europe/Copenhagen", 5)
    return rounded(out, "profile_dow_time", "profile_time")


@query("daily_average", with_views("select airport, date, round(average_queue, 6) as average_queue from daily",
                                   "obs", extra={"wall": WALL, "daily": DAILY}))
def daily(spark, sf):
    wall = latest.with_wall_columns(view(spark, sf, "obs"))
    return rounded(latest.daily_average(wall), "average_queue")


# Scored rows out of lineitem: the price is the truth, simple changes of it the predictions.
SCORED_SQL = """
select l_returnflag as model, l_linenumber as horizon_h, l_extendedprice / 1000.0 as y,
  l_extendedprice / 1000.0 + l_quantity - 25 as mean,
  case when l_linenumber <> 3 then l_extendedprice / 1000.0 - l_quantity / 2 end as q10,
  l_extendedprice / 1000.0 + l_discount * 10 as q50,
  case when l_linenumber <> 3 and l_returnflag <> 'A' then l_extendedprice / 1000.0 + l_tax * 100 end as q90,
  l_orderkey, l_partkey, l_suppkey
from lineitem"""


def scored_rows(spark, sf):
    price, flag, line = F.col("l_extendedprice") / 1000.0, F.col("l_returnflag"), F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        flag.alias("model"), line.alias("horizon_h"), price.alias("y"), (price + F.col("l_quantity") - 25).alias("mean"),
        F.when(line != 3, price - F.col("l_quantity") / 2).alias("q10"), (price + F.col("l_discount") * 10).alias("q50"),
        F.when((line != 3) & (flag != "A"), price + F.col("l_tax") * 100).alias("q90"), "l_orderkey", "l_partkey", "l_suppkey")


@query("pinball_loss", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  round(greatest(0.1 * (l_quantity - l_tax * 500), -0.9 * (l_quantity - l_tax * 500)), 6) as loss_q10,
  round(greatest(0.9 * (l_quantity - l_tax * 500), -0.1 * (l_quantity - l_tax * 500)), 6) as loss_q90
from lineitem""")
def loss(spark, sf):
    pred = F.col("l_tax") * 500
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(pinball("l_quantity", pred, 0.1)).alias("loss_q10"),
        r6(pinball("l_quantity", pred, 0.9)).alias("loss_q90"))


SCORES_SQL = """
select *, abs(y - mean) as abs_err, (y - mean) * (y - mean) as sq_err, abs(y) as abs_y,
  list_avg(list_filter([greatest(0.1 * (y - q10), -0.9 * (y - q10)) + 0 * q10, greatest(0.5 * (y - q50), -0.5 * (y - q50)) + 0 * q50,
    greatest(0.9 * (y - q90), -0.1 * (y - q90)) + 0 * q90], lambda v: v is not null)) as q_loss
from rows"""


@query("score_predictions", with_views("""
select model, horizon_h, l_orderkey, l_partkey, l_suppkey, round(abs_err, 6) as abs_err, round(sq_err, 6) as sq_err,
  round(abs_y, 6) as abs_y, round(q_loss, 6) as q_loss from scores""", extra={"rows": SCORED_SQL, "scores": SCORES_SQL}))
def scores(spark, sf):
    out = scoring.score_predictions(scored_rows(spark, sf)).select(
        "model", "horizon_h", "l_orderkey", "l_partkey", "l_suppkey", "abs_err", "sq_err", "abs_y", "q_loss")
    return rounded(out, "abs_err", "sq_err", "abs_y", "q_loss")


SUMMARY_SQL = """
select model, coalesce(cast(horizon_h as varchar), 'ALL') as horizon, count(*) as n, round(avg(abs_err), 6) as mae,
  round(sqrt(avg(sq_err)), 6) as rmse, round(case when avg(abs_y) <> 0 then 2 * avg(q_loss) / avg(abs_y) end, 6) as wql
from scores group by grouping sets ((model, horizon_h), (model))"""


@query("summarise_backtest", with_views(SUMMARY_SQL, extra={"rows": SCORED_SQL, "scores": SCORES_SQL}))
def summary(spark, sf):
    return rounded(scoring.summarise_backtest(scoring.score_predictions(scored_rows(spark, sf))), "mae", "rmse", "wql")


@query("ranked_summary", with_views("""
select horizon, model, rank, n from (select *, case model when 'N' then 0 when 'R' then 1 else 99 end as rank from summary)
order by horizon, rank, model""", extra={"rows": SCORED_SQL, "scores": SCORES_SQL, "summary": SUMMARY_SQL}))
def ranked(spark, sf):
    out = scoring.summarise_backtest(scoring.score_predictions(scored_rows(spark, sf)))
    out = out.withColumn("rank", scoring.model_rank(order=["N", "R"]))
    return out.select("horizon", "model", "rank", "n").orderBy("horizon", "rank", "model")


@query("holdout_metrics", with_views("""
select count(*) as n_valid, round(avg(abs(y - q50)), 6) as mae, round(sqrt(avg((y - q50) * (y - q50))), 6) as rmse,
  round(avg(l10), 6) as pinball_q10, round(avg(l50), 6) as pinball_q50, round(avg(l90), 6) as pinball_q90,
  round((avg(l10) + avg(l50) + avg(l90)) / 3 / avg(abs(y)), 6) as wql_holdout
from (select *, greatest(0.1 * (y - q10), -0.9 * (y - q10)) as l10, greatest(0.5 * (y - q50), -0.5 * (y - q50)) as l50,
        greatest(0.9 * (y - q90), -0.1 * (y - q90)) as l90
      from rows where q10 is not null and q90 is not null)""", extra={"rows": SCORED_SQL}))
def holdout(spark, sf):
    out = scoring.holdout_metrics(scored_rows(spark, sf).where("q10 is not null and q90 is not null"))
    return rounded(out, *[c for c in out.columns if c != "n_valid"])


@query("trailing_average", with_views("""
select airport, coalesce(cast(floor(avg(queue) + 0.5) as bigint), 0) as average
from (select airport from obs union select 'nowhere') left join (
  select *, row_number() over (partition by airport order by id desc) as rn from obs) using (airport)
where coalesce(rn, 1) <= 24 group by all""", "obs"))
def trailing(spark, sf):
    obs = view(spark, sf, "obs")
    keys = obs.select(KEY).distinct().unionByName(spark.range(1).select(F.lit("nowhere").alias(KEY)))
    return latest.trailing_average(obs, 24, keys)


# Forecast points for the live queries: the 15-minute grid of the last day, a day later.
POINTS = """
select airport, slot + interval 1 day as timestamp, queue - 20 as mean from grid
where slot >= (select max(timestamp) from obs) - interval 1 day and slot + interval 1 day >= (select max(timestamp) from obs)
"""


def points(spark, sf):
    now = latest_moment(view(spark, sf, "obs"))
    rows = grid15(spark, sf).where(F.col("slot") >= now - F.expr("INTERVAL '1' DAY")).select(
        KEY, shift("slot", days=1).alias(TS), (F.col(VALUE) - 20).alias("mean"))
    return live.upcoming(rows, now)


@query("next_hours_average", with_views("""
select airport, cast(floor(greatest(0, coalesce(avg(m) filter (timestamp <= now_ts + interval 2 hour), arg_min(m, timestamp))) + 0.5)
  as bigint) as next_hours_average
from (select *, greatest(mean, 0) as m from points), (select max(timestamp) as now_ts from obs) group by airport""",
                                        "obs", extra={**G15, "points": POINTS}))
def next_hours(spark, sf):
    return live.next_hours_average(points(spark, sf), latest_moment(view(spark, sf, "obs")))


@query("pull_counts", with_views("select airport, status, count(*) as pulls from pulls group by all", "pulls"))
def counts(spark, sf):
    return health.pull_counts(view(spark, sf, "pulls"))


@query("pull_counts_wide", with_views("""
select airport, count(*) filter (status in ('success', 'skipped')) as successes, count(*) filter (status = 'failure') as failures
from pulls group by all""", "pulls"))
def counts_wide(spark, sf):
    return health.pull_counts_wide(view(spark, sf, "pulls"))


def windowed(minutes: int, step: int = 5) -> str:
    return f"""
select airport, edge as at, count(*) filter (status in ('success', 'skipped')) as successes,
  count(*) filter (status = 'failure') as failures
from (select *, unnest(generate_series(time_bucket(interval '{step} minutes', timestamp) + interval {step} minute,
    time_bucket(interval '{step} minutes', timestamp) + interval {minutes} minute, interval {step} minute)) as edge from pulls)
group by all"""


@query("success_rate_10min", with_views("""
select airport, "at", round(successes / (successes + failures), 6) as success_rate from w""",
                                        "pulls", extra={"w": windowed(10).replace("as at", 'as "at"')}))
def rate(spark, sf):
    return rounded(health.success_rate(view(spark, sf, "pulls"), 10), "success_rate")


@query("failures_increase_1h", with_views('select airport, "at", failures, successes from w',
                                          "pulls", extra={"w": windowed(60).replace("as at", 'as "at"')}))
def failures(spark, sf):
    return health.failures_increase(view(spark, sf, "pulls"), 60)


HIST_COLS = {"le_0_5": 0.5, "le_1": 1, "le_2": 2, "le_5": 5, "le_10": 10, "le_30": 30, "le_60": 60}
HIST = ("select airport, " + ", ".join(f"count(*) filter (duration_s <= {b}) as {n}" for n, b in HIST_COLS.items())
        + ", count(duration_s) as le_inf, round(sum(duration_s), 6) as duration_sum from pulls group by all")


@query("duration_histogram", with_views(HIST, "pulls"))
def histogram(spark, sf):
    return rounded(health.duration_histogram(view(spark, sf, "pulls")), "duration_sum")


def _estimate(level: float) -> str:
    names, bounds = list(HIST_COLS), [0, *HIST_COLS.values()]
    text = "case"
    for i, n in enumerate(names):
        below = names[i - 1] if i else "0"
        text += (f" when {n} >= {level} * le_inf then {bounds[i]} + ({bounds[i + 1]} - {bounds[i]})"
                 f" * ({level} * le_inf - {below}) / nullif({n} - {below}, 0)")
    return f"round({text} else 60 end, 6)"


@query("histogram_quantile", with_views(
    f"select airport, {_estimate(0.5)} as p50, {_estimate(0.95)} as p95, {_estimate(0.99)} as p99 from hist",
    "pulls", extra={"hist": HIST}))
def hist_quantile(spark, sf):
    hist = health.duration_histogram(view(spark, sf, "pulls"))
    return rounded(health.histogram_quantile(hist).select(KEY, "p50", "p95", "p99"), "p50", "p95", "p99")


@query("duration_quantiles_10min", with_views(
    f'select airport, "at", {_estimate(0.5)} as p50, {_estimate(0.95)} as p95, {_estimate(0.99)} as p99 from hist',
    "pulls", extra={"hist": "select airport, edge as \"at\", " + ", ".join(
        f"count(*) filter (duration_s <= {b}) as {n}" for n, b in HIST_COLS.items()) + """, count(duration_s) as le_inf
from (select *, unnest(generate_series(time_bucket(interval '5 minutes', timestamp) + interval 5 minute,
    time_bucket(interval '5 minutes', timestamp) + interval 10 minute, interval 5 minute)) as edge from pulls) group by all"""}))
def windowed_quantiles(spark, sf):
    return rounded(health.duration_quantiles(view(spark, sf, "pulls")), "p50", "p95", "p99")


@query("exact_duration_quantiles", with_views("""
select airport, round(quantile_cont(duration_s, 0.5), 6) as p50, round(quantile_cont(duration_s, 0.95), 6) as p95,
  round(quantile_cont(duration_s, 0.99), 6) as p99 from pulls group by all""", "pulls"))
def exact_quantiles(spark, sf):
    return rounded(health.exact_duration_quantiles(view(spark, sf, "pulls")), "p50", "p95", "p99")


@query("last_value_gauges", with_views("""
select airport, arg_max(queue, timestamp) as queue, max(timestamp) as last_pull,
  round((epoch_us((select max(timestamp) from pulls)) - epoch_us(max(timestamp))) / 60000000.0, 6) as minutes_since_pull
from pulls where status = 'success' group by all""", "pulls"))
def gauges(spark, sf):
    pulls = view(spark, sf, "pulls")
    return rounded(health.last_value_gauges(pulls, latest_moment(pulls)), "minutes_since_pull")


FRESH = """
select airport, timestamp, case when airport = 'view' then null else mean end as mean from points"""


def _fresh(spark, sf):
    obs = view(spark, sf, "obs")
    now = latest_moment(obs)
    rows = points(spark, sf).withColumn("mean", F.when(F.col(KEY) != "view", F.col("mean")))
    stats = obs.groupBy(KEY).agg(F.lit("ok").alias("status"), F.count("id").cast("int").alias("context_age_minutes"),
                                 F.lit(0.0).alias("context_synthetic_ratio"))
    keys = obs.select(KEY).distinct().unionByName(spark.range(1).select(F.lit("nowhere").alias(KEY)))
    return health.forecast_freshness(rows, stats, now, keys), rows


FRESHNESS = """
select k.airport, case when k.airport <> 'nowhere' then 'ok' end as status,
  cast(k.n as int) as context_age_minutes, case when k.airport <> 'nowhere' then 0.0::double end as context_synthetic_ratio,
  f.last_at is not null as has_forecast,
  cast(trunc((epoch_us(f.last_at) - epoch_us(n.now_ts)) / 60000000.0) as int) as horizon_remaining_minutes,
  coalesce((epoch_us(f.last_at) - epoch_us(n.now_ts)) / 60000000.0 >= 30, false) as usable
from (select airport, count(*) as n from obs group by all union all select 'nowhere', null) k
left join (select airport, max(timestamp) as last_at from fresh where mean is not null group by all) f using (airport),
(select max(timestamp) as now_ts from obs) n"""


@query("forecast_freshness", with_views(FRESHNESS, "obs", extra={**G15, "points": POINTS, "fresh": FRESH}))
def freshness(spark, sf):
    return _fresh(spark, sf)[0]


@query("service_health", with_views("""
select count(*) filter (usable) as airports_usable, (select count(distinct airport) from fresh) as airports_loaded,
  30 as min_future_horizon_minutes, case when count(*) filter (usable) > 0 then 'ok' else 'stale' end as status
from freshness""", "obs", extra={**G15, "points": POINTS, "fresh": FRESH, "freshness": FRESHNESS}))
def service(spark, sf):
    return health.service_health(*_fresh(spark, sf))


@query("row_counts", with_views("""
select airport, count(*) as context_rows, cast(case when count(*) >= 64 then 32 else 0 end as bigint) as future_rows
from grid group by all""", "obs", extra=G15))
def row_counts(spark, sf):
    """Observed slots per key and the future rows made for it."""
    prepared = prepare_context(view(spark, sf, "obs"), latest_moment(view(spark, sf, "obs")))
    future = future_grid(prepared).groupBy(KEY).agg(F.count(F.lit(1)).alias("future_rows"))
    observed = prepared.grid.groupBy(KEY).agg(F.count(F.lit(1)).alias("context_rows"))
    return observed.join(future, KEY, "left").na.fill(0)


