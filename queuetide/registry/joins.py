"""Lookups and as-of joins over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import KEY, LOCAL_TZ, TS, VALUE
from ..functions.calendar import shift
from ..operators import asof, latest
from ..operators.grid import grid_average
from ..operators import health
from ..operators.health import status_table
from ..operators.profiles import build_profiles, lag_lookup, profile_lookup
from ..plans.backtest import Setup, backtest_frame, last_at_origin
from ..sources.observations import clean_obs, latest_moment
from .catalog import query, r6, rounded
from .reading import CLEAN, GRID5, GRID15, LOCAL, profile_views
from .tables import table, view, with_views


def clean(spark, sf):
    return clean_obs(view(spark, sf, "obs"), drop_negative=True)


def grid5(spark, sf):
    return grid_average(clean(spark, sf), 5)


def grid15(spark, sf):
    return grid_average(clean(spark, sf), 15)


G5 = {"clean": CLEAN, "grid": GRID5}
G15 = {"clean": CLEAN, "grid": GRID15}


@query("profile_lookup", with_views("""
select r.event_id as id, round(coalesce(s.m, t.m, a.m, 0.0), 6) as profile_dow_time,
  round(coalesce(t.m, a.m, 0.0), 6) as profile_time
from (select *, cast(isodow(l) - 1 as int) as weekday, cast(hour(l) as int) as hour,
        cast(minute(l) // 5 * 5 as int) as minute
      from (select event_id, case when event_id % 50 = 0 then 'nowhere' else event_type end as airport,
              ((ts + interval 3 hour) at time zone 'UTC') at time zone 'Europe/Copenhagen' as l from events)) r
left join p_slot s using (airport, weekday, hour, minute)
left join p_time t using (airport, hour, minute) left join p_all a using (airport)
""", "obs", extra={**G5, **profile_views("grid", LOCAL, 5)}))
def profiles(spark, sf):
    asked = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), shift("ts", minutes=180).alias("slot"),
        F.when(F.col("event_id") % 50 == 0, "nowhere").otherwise(F.col("event_type")).alias(KEY))
    out = profile_lookup(asked, build_profiles(grid5(spark, sf), LOCAL_TZ, 5))
    return rounded(out, "profile_dow_time", "profile_time").drop("slot", KEY)


@query("lag_lookup", with_views("""
select g.airport, g.slot, round(coalesce(l1.queue, s.m, t.m, a.m), 6) as lag_1d,
  round(coalesce(l7.queue, s.m, t.m, a.m), 6) as lag_7d
from parts g left join grid l1 on l1.airport = g.airport and l1.slot = g.slot - interval 1 day
left join grid l7 on l7.airport = g.airport and l7.slot = g.slot - interval 7 day
left join p_slot s on s.airport = g.airport and s.weekday = g.weekday and s.hour = g.hour and s.minute = g.minute
left join p_time t on t.airport = g.airport and t.hour = g.hour and t.minute = g.minute
left join p_all a on a.airport = g.airport
""", "obs", extra={**G15, **profile_views("grid", "slot", 1)}))
def lags(spark, sf):
    grid = grid15(spark, sf)
    out = profile_lookup(grid, build_profiles(grid, None, 1), slot_name="expected", time_name="_t")
    out = lag_lookup(out, grid, (1, 7), "expected", name="lag_{}d")
    return rounded(out, "lag_1d", "lag_7d").select(KEY, "slot", "lag_1d", "lag_7d")


# Targets are every event moved by 37 minutes; samples are the cleaned readings.
TARGETS = "select event_id as id, event_type as airport, ts + interval 37 minute as target from events"


def targets(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias(KEY),
                                             shift("ts", minutes=37).alias("target"))


@query("asof_nearest", with_views("""
select b.id, case when f.timestamp is not null and f.timestamp - b.target <= interval 5 minute
      and (b.pts is null or f.timestamp - b.target <= b.target - b.pts) then f.queue
    when b.target - b.pts <= interval 5 minute then b.pq end as queue
from (select t.*, p.timestamp as pts, p.queue as pq from targets t asof left join clean p
      on t.airport = p.airport and t.target >= p.timestamp) b
asof left join clean f on b.airport = f.airport and b.target <= f.timestamp
""", "obs", extra={"clean": CLEAN, "targets": TARGETS}))
def nearest(spark, sf):
    out = asof.asof_nearest(targets(spark, sf), clean(spark, sf), [VALUE], within_min=5, target_ts="target", tie="id")
    return out.select("id", VALUE)


@query("asof_backward", with_views("""
select t.id, p.queue, p.timestamp from targets t
asof left join clean p on t.airport = p.airport and t.target >= p.timestamp
""", "obs", extra={"clean": CLEAN, "targets": TARGETS}))
def backward(spark, sf):
    samples = clean(spark, sf).withColumn("seen", F.col(TS))
    out = asof.asof_backward(targets(spark, sf), samples, [VALUE, "seen"], target_ts="target", tie="id")
    return out.select("id", VALUE, F.col("seen").alias(TS))


@query("asof_forward", with_views("""
select t.id, case when p.timestamp - t.target <= interval 60 minute then p.queue end as queue
from targets t asof left join clean p on t.airport = p.airport and t.target <= p.timestamp
""", "obs", extra={"clean": CLEAN, "targets": TARGETS}))
def forward(spark, sf):
    out = asof.asof_forward(targets(spark, sf), clean(spark, sf), [VALUE], target_ts="target", tie="id", within_min=60)
    return out.select("id", VALUE)


@query("historical_comparison", with_views("""
select airport, arg_max(queue, timestamp) filter (timestamp <= now_ts - interval 1 day) as yesterday,
  arg_max(queue, timestamp) filter (timestamp <= now_ts - interval 1 month) as month,
  arg_max(queue, timestamp) filter (timestamp <= now_ts - interval 12 month) as year
from obs, (select max(timestamp) + interval 3 day as now_ts from obs) group by airport""", "obs"))
def historical(spark, sf):
    obs = view(spark, sf, "obs")
    return latest.historical_comparison(obs, latest_moment(obs) + F.expr("INTERVAL '3' DAY"))


WALL = """
select *, cast(l as date) as date, hour(l) as hour from (
  select *, ((timestamp at time zone 'UTC') at time zone 'Europe/Copenhagen') as l from obs)"""
DAILY = "select airport, date, avg(queue) as average_queue from wall where hour between 7 and 22 group by all"


@query("daily_lag_map", with_views("""
select w.id, round(y.average_queue, 6) as yesterday_average_queue, round(k.average_queue, 6) as lastweek_average_queue
from wall w left join daily y on y.airport = w.airport and y.date = w.date - 1
left join daily k on k.airport = w.airport and k.date = w.date - 7
""", "obs", extra={"wall": WALL, "daily": DAILY}))
def daily_lags(spark, sf):
    wall = latest.with_wall_columns(view(spark, sf, "obs"))
    out = latest.daily_lag_map(wall, latest.daily_average(wall))
    return rounded(out, "yesterday_average_queue", "lastweek_average_queue").select(
        "id", "yesterday_average_queue", "lastweek_average_queue")


# A forecast to look into: the 15-minute grid moved one week ahead.
FORECAST = "select airport, slot + interval 7 day as timestamp, queue as mean from grid"


@query("match_within", with_views("""
select t.id, round(coalesce(f.mean, t.value), 6) as predicted from (
  select event_id as id, event_type as airport, ts + interval 7 day as target, value from events) t
asof left join fc f on t.airport = f.airport and t.target - interval 15 minute <= f.timestamp
""".replace("coalesce(f.mean", "coalesce(case when f.timestamp <= t.target + interval 15 minute then f.mean end"),
                               "obs", extra={**G15, "fc": FORECAST}))
def match(spark, sf):
    asked = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias(KEY),
                                              shift("ts", days=7).alias("target"), "value")
    forecast = grid15(spark, sf).select(KEY, shift("slot", days=7).alias(TS), F.col(VALUE).alias("mean"))
    out = asof.match_within(asked, forecast, ["mean"], target_ts="target")
    return out.select("id", r6(F.coalesce("mean", "value")).alias("predicted"))


@query("forecast_grid_match", with_views("""
select t.event_id as id, round(case when f.timestamp is not null and f.timestamp - t.ts <= interval 450 second
      and (t.pts is null or f.timestamp - t.ts <= t.ts - t.pts) then f.mean
    when t.ts - t.pts <= interval 450 second then t.pm end, 6) as mean
from (select e.*, p.timestamp as pts, p.mean as pm from events e asof left join fc p
      on e.event_type = p.airport and e.ts >= p.timestamp) t
asof left join fc f on t.event_type = f.airport and t.ts <= f.timestamp
""", "obs", extra={**G15, "fc": FORECAST}))
def grid_match(spark, sf):
    asked = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias(KEY), "ts")
    forecast = grid15(spark, sf).select(KEY, shift("slot", days=7).alias(TS), F.col(VALUE).alias("mean"))
    out = asof.asof_nearest(asked, forecast, ["mean"], within_min=7.5, target_ts="ts")
    return out.select("id", r6("mean").alias("mean"))


# Backtest over the given month: two weeks of origins, the usual horizons.
def setup(spark, sf, **changes):
    return Setup(as_of=latest_moment(view(spark, sf, "obs")), **{"backtest_days": 14, "train_days": 10, **changes}).resolved(spark)


FRAME = {
    "edge": "select time_bucket(interval '5 minutes', max(timestamp)) - interval 168 hour as last_origin from obs",
    "frame": """select airport, origin, horizon_h, origin + to_hours(horizon_h) as target
from (select distinct airport from grid),
  (select unnest(generate_series(last_origin - interval 14 day, last_origin, interval 6 hour)) as origin from edge),
  (select unnest([1, 2, 4, 8, 24, 168]) as horizon_h)""",
}


@query("backtest_frame", with_views("select * from frame", "obs", extra={**G5, **FRAME}))
def frame(spark, sf):
    return backtest_frame(grid5(spark, sf), setup(spark, sf))


@query("context_upto_origin", with_views("""
select o.airport, o.origin, round(g.queue, 6) as last_value
from (select distinct airport, origin from frame) o
asof left join grid g on o.airport = g.airport and o.origin >= g.slot
""", "obs", extra={**G5, **FRAME}))
def upto(spark, sf):
    s, grid = setup(spark, sf), grid5(spark, sf)
    return rounded(last_at_origin(grid, backtest_frame(grid, s), s), "last_value")


STATUS = """
select airport, q.queue, round(s.m, 6) as minutes_since_pull, o.n as successes_1h, b.n as failures_1h
from (select airport, arg_max(queue, timestamp) as queue from pulls where status = 'success' group by all) q
full join (select airport, (epoch_us((select max(timestamp) from pulls)) - epoch_us(max(timestamp))) / 60000000.0 as m
           from pulls where status = 'success' group by all) s using (airport)
full join (select airport, count(*) as n from pulls where status = 'success'
           and timestamp > (select max(timestamp) from pulls) - interval 1 hour group by all) o using (airport)
full join (select airport, count(*) as n from pulls where status = 'failure'
           and timestamp > (select max(timestamp) from pulls) - interval 1 hour group by all) b using (airport)"""


@query("status_table", with_views(STATUS, "pulls"))
def status(spark, sf):
    pulls = view(spark, sf, "pulls")
    return rounded(status_table(pulls, latest_moment(pulls)), "minutes_since_pull")


@query("merge_metrics", with_views(STATUS, "pulls"))
def merged(spark, sf):
    """The same table out of four separate frames."""
    pulls = view(spark, sf, "pulls")
    now = latest_moment(pulls)
    gauges = rounded(health.last_value_gauges(pulls, now), "minutes_since_pull").where(F.col("last_pull").isNotNull())
    ok, bad = (pulls.where((F.col("status") == s) & (F.col(TS) > now - F.expr("INTERVAL '1' HOUR")))
               .groupBy(KEY).agg(F.count(F.lit(1)).alias(name))
               for s, name in (("success", "successes_1h"), ("failure", "failures_1h")))
    return health.merge_metrics(gauges.select(KEY, VALUE), gauges.select(KEY, "minutes_since_pull"), ok, bad)
