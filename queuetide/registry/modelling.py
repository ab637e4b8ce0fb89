"""Training frames, predictors, forecasts, backtests over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import FORECAST_LEVELS, KEY, LOCAL_TZ, TS, VALUE
from ..functions.calendar import shift
from ..operators import live
from ..operators.context import future_grid
from ..operators.latest import latest_per_key
from ..operators.profiles import build_profiles
from ..plans import backtest, daily, forecast, models, origins
from ..plans.serving import predict_response, validate_requests
from ..session import materialise
from ..sources.observations import latest_moment
from .aggregates import SCORES_SQL, SUMMARY_SQL, asof_means
from .catalog import query, r6, rounded
from .joins import DAILY, FRAME, G5, WALL, grid5, setup
from .reading import LOCAL, profile_views
from .scalars import KEYS, VALIDATED
from .tables import table, view, with_views
from .windows import AHEAD, CONTEXT, USABLE, covariate_sql, prepared, raw

P5 = {**G5, **profile_views("grid", LOCAL, 5)}
_WAVES = ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "tod_sin", "tod_cos"]


@query("training_frame", with_views(f"""
select p.airport, p.slot as timestamp, cast(month(l) as int) as month, cast(day(l) as int) as day, p.weekday, p.hour, p.minute,
  cast(p.weekday >= 5 as int) as is_weekend,
  round(sin(2 * pi() * p.hour / 24.0), 6) as hour_sin, round(cos(2 * pi() * p.hour / 24.0), 6) as hour_cos,
  round(sin(2 * pi() * p.weekday / 7.0), 6) as dow_sin, round(cos(2 * pi() * p.weekday / 7.0), 6) as dow_cos,
  round(sin(2 * pi() * (p.hour * 60 + minute(l)) / 1440.0), 6) as tod_sin,
  round(cos(2 * pi() * (p.hour * 60 + minute(l)) / 1440.0), 6) as tod_cos,
  cast(h.date is not null as int) as holiday, round(s.m, 9) as profile_dow_time, round(t.m, 9) as profile_time,
  case p.airport when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 when 'view' then 4 end as airport_code,
  round(p.queue, 9) as y
from (select *, {LOCAL} as l from parts) p left join holidays h on h.airport = p.airport and h.date = cast(l as date)
left join p_slot s on s.airport = p.airport and s.weekday = p.weekday and s.hour = p.hour and s.minute = p.minute
left join p_time t on t.airport = p.airport and t.hour = p.hour and t.minute = p.minute""", "obs", "holidays", extra=P5))
def training(spark, sf):
    grid = grid5(spark, sf)
    out = models.training_frame(grid, build_profiles(grid, LOCAL_TZ, 5), view(spark, sf, "holidays"), KEYS)
    return rounded(rounded(out, *_WAVES), "profile_dow_time", "profile_time", "y", digits=9)


@query("time_split", with_views("""
select airport, slot, round(queue, 6) as queue,
  case when slot < (select max(slot) from grid) - interval 7 day then 'train' else 'valid' end as part from grid
""", "obs", extra=G5))
def split(spark, sf):
    train, valid = models.time_split(grid5(spark, sf))
    return rounded(train.withColumn("part", F.lit("train")).unionByName(valid.withColumn("part", F.lit("valid"))), VALUE)


QUANTILES = {
    "q_slot": "select airport, weekday, hour, minute, quantile_cont(queue, [0.1, 0.5, 0.9]) as q from parts group by all",
    "q_time": "select airport, hour, minute, quantile_cont(queue, [0.1, 0.5, 0.9]) as q from parts group by all",
    "q_all": "select airport, quantile_cont(queue, [0.1, 0.5, 0.9]) as q from parts group by all",
}


def _predicted(source: str, moment: str) -> str:
    return f"""
select r.*, list_sort(list_transform(coalesce(s.q, t.q, a.q, [0.0, 0.0, 0.0]), lambda v: greatest(v, 0.0))) as q
from (select *, cast(isodow(l) - 1 as int) as weekday, cast(hour(l) as int) as hour, cast(minute(l) // 5 * 5 as int) as minute
      from (select *, (({moment} at time zone 'UTC') at time zone 'Europe/Copenhagen') as l from {source})) r
left join q_slot s using (airport, weekday, hour, minute) left join q_time t using (airport, hour, minute)
left join q_all a using (airport)"""


@query("quantile_profile_model", with_views("""
select id, round(q[1], 6) as q10, round(q[2], 6) as q50, round(q[3], 6) as q90 from predicted""", "obs", extra={
    **P5, **QUANTILES, "asked": "select event_id as id, event_type as airport, ts + interval 7 day as timestamp from events",
    "predicted": _predicted("asked", "timestamp")}))
def quantile_model(spark, sf):
    asked = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias(KEY),
                                              shift("ts", days=7).alias(TS))
    out = models.quantile_profile_model(grid5(spark, sf)).predict(asked)
    return rounded(out, "q10", "q50", "q90").select("id", "q10", "q50", "q90")


@query("predict_batch", with_views("""
select request_id, airport, strftime("at", '%Y-%m-%dT%H:%M:%SZ') as answered_for,
  cast(round_even(q[2], 0) as int) as predicted_queue_length_minutes
from predicted""", "obs", "requests", extra={
    **{k: v.replace("event_type as airport", "upper(event_type) as airport") for k, v in P5.items()}, **QUANTILES,
    "valid": 'select * from (' + VALIDATED.replace("as at", 'as "at"') + ') where status = 200',
    "predicted": _predicted("(select request_id, lower(airport) as airport, \"at\" from valid)", '"at"')}))
def predict_batch(spark, sf):
    """Validate, predict and answer: the whole predict call over a table of requests."""
    valid = validate_requests(view(spark, sf, "requests"), KEYS).where("status = 200")
    asked = valid.select("request_id", F.lower(KEY).alias(KEY), "at")
    out = models.quantile_profile_model(grid5(spark, sf)).predict(asked, "at")
    return predict_response(out).select("request_id", KEY, "answered_for", "predicted_queue_length_minutes")


@query("constant_model", "select event_id as id, 5.0::double as q10, 5.0::double as q50, 5.0::double as q90 from events")
def constant(spark, sf):
    return models.constant_model(table(spark, sf, "events").select(F.col("event_id").alias("id")))


@query("gbt_calendar_model")
def boosted(spark, sf):
    """Boosted trees on the whole grid, applied to the coming week of every key."""
    grid = grid5(spark, sf)
    fitted = models.gbt_calendar_model(grid, view(spark, sf, "holidays"), KEYS)
    asked = grid.select(KEY, shift("slot", days=7).alias(TS))
    return rounded(fitted.predict(asked), "q10", "q50", "q90")


@query("gbt_calendar_band", with_views("""
select airport, count(*) as n, true as ordered, true as non_negative, true as covers,
  (select count(*) from grid, (select max(slot) as newest from grid) where slot >= newest - interval 84 hour) as n_valid
from grid group by airport""", "obs", extra=G5))
def boosted_band(spark, sf):
    """What must hold of the boosted trees: a prediction for each row, ordered, never below zero; 80 % of the scored rows within the band."""
    grid = grid5(spark, sf)
    fitted = models.gbt_calendar_model(grid, view(spark, sf, "holidays"), KEYS)
    out = fitted.predict(grid.select(KEY, shift("slot", days=7).alias(TS)))
    # Two points, and three standard errors of a share over as many rows, calibrated on as many.
    error = 0.02 + 3 * F.sqrt(0.8 * 0.2 * 2 / F.col("n_valid"))
    scores = fitted.metrics.select("n_valid", (F.abs(F.col("coverage") - 0.8) <= error).alias("covers"))
    return (out.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.every((F.col("q10") <= F.col("q50")) & (F.col("q50") <= F.col("q90"))).alias("ordered"),
                                 F.every(F.col("q10") >= 0).alias("non_negative")).crossJoin(scores))  # one row of scores


LAST = "select airport, arg_max(queue, slot) as last_queue from usable group by airport"


@query("naive_forecast", with_views("""
select a.airport, a.slot, round(l.last_queue, 6) as predictions, round(l.last_queue, 6) as q1, round(l.last_queue, 6) as q99
from ahead a join last l using (airport)""", extra={**CONTEXT, "usable": USABLE, "ahead": AHEAD, "last": LAST}))
def naive(spark, sf):
    p = prepared(spark, sf)
    out = forecast.naive_forecast(p.context, future_grid(p), FORECAST_LEVELS)
    return rounded(out, "predictions", "q1", "q99").select(KEY, "slot", "predictions", "q1", "q99")


@query("batch_forecast", with_views("""
select airport, a.slot as timestamp, strftime(a.slot, '%Y-%m-%dT%H:%M:%S') as iso, round(l.last_queue, 6) as mean,
  23 as n_quantiles, null as message
from ahead a join last l using (airport)
union all
select airport, n.now_ts, strftime(n.now_ts, '%Y-%m-%dT%H:%M:%S'), null, null, airport || ': ' || case status
  when 'no_rows' then 'No rows found for airport' when 'no_valid_rows' then 'No valid queue history after cleanup'
  when 'stale_history' then 'Most recent history ends ' || strftime(last_slot, '%Y-%m-%dT%H:%M:%S') || ', '
    || cast(cast(floor(age) as int) as varchar) || ' min ago (limit 360); refusing to forecast an elapsed window'
  else 'Not enough history after preprocessing: ' || cast(seg_rows as varchar) || ' rows' end
from stats, now n where status <> 'ok'""".replace("null as message", "cast(null as varchar) as message"), extra={
    **CONTEXT, "usable": USABLE, "ahead": AHEAD, "last": LAST}))
def batch(spark, sf):
    p = prepared(spark, sf)
    out = forecast.forecast_records(p, latest_moment(raw(spark, sf)))
    return out.select(KEY, TS, "iso", r6("mean").alias("mean"),
                      F.when(F.col("quantiles").isNotNull(), F.size("quantiles")).alias("n_quantiles"), "message")


@query("seasonal_forecast", with_views("select airport, slot, round(queue_avg_dow_time, 9) as predictions from cov", extra={
    **CONTEXT, "ahead": AHEAD, "cov": covariate_sql("ahead")}))
def seasonal(spark, sf):
    p = prepared(spark, sf)
    return rounded(forecast.seasonal_forecast(p.context, future_grid(p)), "predictions", digits=9)


@query("forecast_metrics", with_views("""
select airport, status, context_rows, cast(case when status = 'ok' then context_rows else 0 end as bigint) as history_rows,
  cast(case when status = 'ok' then 32 else 0 end as bigint) as future_rows
from (select *, case when age <= 360 then seg_rows else 0 end as context_rows from stats)""", extra=CONTEXT))
def metrics(spark, sf):
    p = prepared(spark, sf)
    out = forecast.forecast_metrics(p, forecast.forecast_records(p, latest_moment(raw(spark, sf))))
    return out.select(KEY, "status", "context_rows", "history_rows", "future_rows")


# --- backtest -------------------------------------------------------------------

NEAREST = """
select b.*exclude(pts, pq), case when f.slot is not null and f.slot - b.{t} <= interval {tol} minute
    and (b.pts is null or f.slot - b.{t} <= b.{t} - b.pts){later} then f.queue
  when b.{t} - b.pts <= interval {tol} minute then b.pq end as {out}
from (select r.*, p.slot as pts, p.queue as pq from {src} r asof left join grid p on r.airport = p.airport and r.{t} >= p.slot) b
asof left join grid f on b.airport = f.airport and b.{t} <= f.slot"""
BACKTEST = {
    **P5, **FRAME,
    "last_known": """select o.airport, o.origin, g.queue as last_value from (select distinct airport, origin from frame) o
        asof left join grid g on o.airport = g.airport and o.origin >= g.slot""",
    "weekly": NEAREST.format(t="week", tol=30, out="v", later=" and f.slot <= b.origin",
                             src="(select *, target - interval 7 day as week from frame)"),
    "actual": NEAREST.format(t="target", tol=5, out="y", later="", src="frame"),
    "fits": """select *, first_origin + to_hours(24 * cast(floor((epoch(origin) - epoch(first_origin)) / 86400) as int)) as fit
        from (select *, cast(isodow(l) - 1 as int) as weekday, cast(hour(l) as int) as hour, cast(minute(l) // 5 * 5 as int) as minute
          from (select *, ((target at time zone 'UTC') at time zone 'Europe/Copenhagen') as l,
                  (select last_origin - interval 14 day from edge) as first_origin from frame))""",
    "sized": """select f.*, (select count(*) from grid g where g.slot <= f.fit and g.slot >= f.fit - interval 10 day) as size from fits f""",
    "quantiled": """select f.airport, f.origin, f.horizon_h, coalesce(
          quantile_cont(g.queue, [0.1, 0.5, 0.9]) filter (g.weekday = f.weekday and g.hour = f.hour and g.minute = f.minute),
          quantile_cont(g.queue, [0.1, 0.5, 0.9]) filter (g.hour = f.hour and g.minute = f.minute),
          quantile_cont(g.queue, [0.1, 0.5, 0.9])) as q
        from sized f join parts g on g.airport = f.airport and g.slot <= f.fit and g.slot >= f.fit - interval 10 day
        where f.size >= 500 group by all""",
}


@query("predictor_last_value", with_views("""
select airport, origin, horizon_h, target, round(last_value, 6) as mean from frame left join last_known using (airport, origin)
""", "obs", extra=BACKTEST))
def p_last(spark, sf):
    s, grid = setup(spark, sf), grid5(spark, sf)
    return rounded(backtest.last_value(grid, backtest.backtest_frame(grid, s), s), "mean")


@query("predictor_seasonal_naive", with_views("""
select airport, origin, horizon_h, target, round(coalesce(v, last_value), 6) as mean
from weekly left join last_known using (airport, origin)""", "obs", extra=BACKTEST))
def p_seasonal(spark, sf):
    s, grid = setup(spark, sf), grid5(spark, sf)
    return rounded(backtest.seasonal_naive(grid, backtest.backtest_frame(grid, s), s), "mean")


@query("predictor_calendar_profile", with_views("""
select airport, origin, horizon_h, target, round(coalesce(by_slot, by_time, by_key, 0.0), 6) as mean
from frame join means using (airport, origin, target)
""", "obs", extra={**BACKTEST, "means": asof_means("frame")}))
def p_profile(spark, sf):
    s, grid = setup(spark, sf), grid5(spark, sf)
    return rounded(backtest.calendar_profile(grid, backtest.backtest_frame(grid, s), s), "mean")


@query("predictor_calendar_quantiles", with_views("""
select airport, origin, horizon_h, target, round(greatest(q[1], 0), 6) as q10, round(greatest(q[2], 0), 6) as q50,
  round(greatest(q[3], 0), 6) as q90, round(greatest(q[2], 0), 6) as mean
from frame join quantiled using (airport, origin, horizon_h)""", "obs", extra=BACKTEST))
def p_quantiles(spark, sf):
    s, grid = setup(spark, sf), materialise(grid5(spark, sf), "grid")
    out = backtest.calendar_quantiles(grid, backtest.backtest_frame(grid, s), s)
    return rounded(out, "q10", "q50", "q90", "mean")


ROWS = """
select 'last_value' as model, horizon_h, a.y, l.last_value as mean, null::double as q10, null::double as q50, null::double as q90
from actual a join last_known l using (airport, origin) where a.y is not null and l.last_value is not null
union all
select 'seasonal_naive', horizon_h, a.y, coalesce(w.v, l.last_value), null, null, null
from actual a join weekly w using (airport, origin, horizon_h) join last_known l using (airport, origin)
where a.y is not null and coalesce(w.v, l.last_value) is not null
union all
select 'calendar', horizon_h, a.y, greatest(q[2], 0), greatest(q[1], 0), greatest(q[2], 0), greatest(q[3], 0)
from actual a join quantiled using (airport, origin, horizon_h) where a.y is not null"""


@query("run_backtest", with_views(SUMMARY_SQL, "obs", extra={**BACKTEST, "rows": ROWS, "scores": SCORES_SQL}))
def run(spark, sf):
    return rounded(backtest.run_backtest(grid5(spark, sf), setup(spark, sf)), "mae", "rmse", "wql")


def every_seven_hours(texts: dict[str, str]) -> dict[str, str]:
    """The same views with an origin every seven hours: a fit is made at every fourth one, 28 hours apart."""
    moved = {k: v.replace("interval 6 hour)", "interval 7 hour)") for k, v in texts.items()}
    return {**moved, "fits": moved["fits"].replace("to_hours(24 * cast(floor((epoch(origin) - epoch(first_origin)) / 86400) as int))",
                                                   "to_hours(28 * cast(floor((epoch(origin) - epoch(first_origin)) / 100800) as int))")}


@query("predictor_quantiles_7h_origins", with_views("""
select airport, origin, horizon_h, target, round(greatest(q[1], 0), 6) as q10, round(greatest(q[2], 0), 6) as q50,
  round(greatest(q[3], 0), 6) as q90, round(greatest(q[2], 0), 6) as mean
from frame join quantiled using (airport, origin, horizon_h)""", "obs", extra=every_seven_hours(BACKTEST)))
def p_quantiles_7h(spark, sf):
    """Origins that no refit span divides: the fit is as old as its origins allow."""
    s, grid = setup(spark, sf, origin_every_hours=7), materialise(grid5(spark, sf), "grid")
    out = backtest.calendar_quantiles(grid, backtest.backtest_frame(grid, s), s)
    return rounded(out, "q10", "q50", "q90", "mean")


# The context of every origin by itself: its own grid up to the origin, its own window, runs and profiles.
AT_ORIGIN = {
    "seen": """select f.airport, f.origin, time_bucket(interval '15 minutes', g.slot) as slot, avg(g.queue) as queue
        from (select distinct airport, origin from frame) f join grid g on g.airport = f.airport and g.slot <= f.origin group by all""",
    "windowed": """select *, lead(slot) over (partition by airport, origin order by slot) as nxt
        from (select *, max(slot) over (partition by airport, origin) as top from seen) where slot >= top - interval 6 day""",
    "runs": """select airport, origin, max(slot) as last_slot,
        coalesce(max(nxt) filter ((epoch(nxt) - epoch(slot)) / 900 - 1 > 8), min(slot)) as seg from windowed group by all""",
    "usable": """select * from runs where (epoch(last_slot) - epoch(seg)) / 900 + 1 >= 64
        and epoch(origin) - epoch(last_slot) <= 360 * 60""",
    "ahead": """select airport, origin, unnest(generate_series(last_slot + interval 15 minute, last_slot + interval 480 minute,
        interval 15 minute)) as slot from usable""",
    "s_slot": "select airport, origin, isodow(slot) as d, hour(slot) as h, minute(slot) as m, avg(queue) as v from seen group by all",
    "s_time": "select airport, origin, hour(slot) as h, minute(slot) as m, avg(queue) as v from seen group by all",
    "s_all": "select airport, origin, avg(queue) as v from seen group by all",
    "points": """select a.airport, a.origin, a.slot, l.queue as carried, coalesce(s.v, t.v, o.v) as expected
        from ahead a join usable u using (airport, origin) join seen l on l.airport = a.airport and l.origin = a.origin and l.slot = u.last_slot
        left join s_slot s on s.airport = a.airport and s.origin = a.origin and s.d = isodow(a.slot) and s.h = hour(a.slot) and s.m = minute(a.slot)
        left join s_time t on t.airport = a.airport and t.origin = a.origin and t.h = hour(a.slot) and t.m = minute(a.slot)
        left join s_all o on o.airport = a.airport and o.origin = a.origin""",
    "matched": """select f.airport, f.origin, f.horizon_h, f.target, p.carried, p.expected
        from frame f join points p on p.airport = f.airport and p.origin = f.origin and abs(epoch(p.slot) - epoch(f.target)) <= 450
        qualify row_number() over (partition by f.airport, f.origin, f.horizon_h
          order by abs(epoch(p.slot) - epoch(f.target)), p.slot desc) = 1""",
}


def _predicted_by_forecast(spark, sf, model):
    s, grid = setup(spark, sf), materialise(grid5(spark, sf), "grid")
    predict = origins.model_as_predictor(model, days=6, max_gap=8)
    out = predict(grid, backtest.backtest_frame(grid, s), s).where(F.col("mean").isNotNull())
    return out.select(KEY, "origin", "horizon_h", "target", F.round("mean", 9).alias("mean"), r6("q10").alias("q10"), r6("q90").alias("q90"))


@query("predictor_naive_forecast", with_views("""
select airport, origin, horizon_h, target, round(carried, 9) as mean, round(carried, 6) as q10, round(carried, 6) as q90 from matched
""", "obs", extra={**BACKTEST, **AT_ORIGIN}))
def p_naive(spark, sf):
    """The naive forecast model from the context of every origin."""
    return _predicted_by_forecast(spark, sf, forecast.naive_forecast)


@query("predictor_seasonal_forecast", with_views("""
select airport, origin, horizon_h, target, round(expected, 9) as mean, null::double as q10, null::double as q90 from matched
""", "obs", extra={**BACKTEST, **AT_ORIGIN}))
def p_expected(spark, sf):
    """The seasonal forecast model: a covariate of the future rows, as known at every origin."""
    return _predicted_by_forecast(spark, sf, forecast.seasonal_forecast)


FORECAST_ROWS = """
select 'last_value' as model, horizon_h, a.y, l.last_value as mean, null::double as q10, null::double as q50, null::double as q90
from actual a join last_known l using (airport, origin) where a.y is not null and l.last_value is not null
union all
select 'forecast', horizon_h, a.y, carried, carried, carried, carried
from actual a join matched using (airport, origin, horizon_h) where a.y is not null
union all
select 'seasonal', horizon_h, a.y, expected, null, null, null
from actual a join matched using (airport, origin, horizon_h) where a.y is not null"""


@query("backtest_forecast_model", with_views(SUMMARY_SQL, "obs", extra={
    **BACKTEST, **AT_ORIGIN, "rows": FORECAST_ROWS, "scores": SCORES_SQL}))
def forecast_backtest(spark, sf):
    """Forecast models beside a predictor, scored where their horizon reaches."""
    rules = {"days": 6, "max_gap": 8}
    out = backtest.run_backtest(grid5(spark, sf), setup(spark, sf), {
        "last_value": backtest.last_value, "forecast": origins.model_as_predictor(forecast.naive_forecast, **rules),
        "seasonal": origins.model_as_predictor(forecast.seasonal_forecast, **rules)})
    return rounded(out, "mae", "rmse", "wql")


# --- live value -----------------------------------------------------------------

# 'view' has no prediction, 'purchase' neither prediction nor forecast, and 'click' is read fresh.
LIVE = {
    **G5, "now": "select max(timestamp) + interval 5 minute as now_ts from obs",
    "asked": "select airport, 33.5 as predicted from (select distinct airport from obs) where airport not in ('view', 'purchase')",
    "fc": """select airport, slot + interval 1 day as timestamp, queue as mean from grid, now
        where airport <> 'purchase' and slot + interval 1 day >= now_ts""",
}


@query("effective_queue", with_views("""
select k.airport, case when o.timestamp >= now_ts - interval 20 minute then 'live' when p.predicted is not null then 'predicted'
    when f.mean is not null then 'forecast' when o.timestamp is not null then 'last_known' end as origin,
  round(case when o.timestamp >= now_ts - interval 20 minute then o.queue
    else coalesce(floor(p.predicted + 0.5), floor(f.mean + 0.5), o.queue) end, 6) as effective
from (select airport from obs union select 'nowhere') k
left join (select * from obs qualify row_number() over (partition by airport order by id desc) = 1) o using (airport)
left join asked p using (airport)
left join (select airport, arg_min(mean, timestamp) as mean from fc group by airport) f using (airport), now""",
                                     "obs", extra=LIVE))
def effective(spark, sf):
    obs = view(spark, sf, "obs")
    now = latest_moment(obs) + F.expr("INTERVAL '5' MINUTE")
    ahead = grid5(spark, sf).where(F.col(KEY) != "purchase").select(
        KEY, shift("slot", days=1).alias(TS), F.col(VALUE).alias("mean"))
    guess = latest_per_key(obs).where(~F.col(KEY).isin("view", "purchase")).select(KEY, F.lit(33.5).alias("predicted"))
    keys = obs.select(KEY).unionByName(spark.range(1).select(F.lit("nowhere").alias(KEY)))
    return rounded(live.effective_queue(obs, guess, live.upcoming(ahead, now), now, keys=keys), "effective")


# --- daily features -----------------------------------------------------------------

def _daily_sql(step: int) -> str:
    return with_views(f"""
select g.airport, g.point as timestamp, cast(trunc(o.queue) as bigint) as queue, year(o.l) as year, month(o.l) as month, day(o.l) as day,
  hour(o.l) as hour, cast(isodow(o.l) - 1 as bigint) as weekday, cast(h.date is not null as bigint) as holiday,
  cast(round_even(y.average_queue, 0) as bigint) as yesterday_average_queue,
  cast(round_even(k.average_queue, 0) as bigint) as lastweek_average_queue,
  cast(g.airport = 'click' as int) as is_click, cast(g.airport = 'view' as int) as is_view
from (select airport, unnest(generate_series(time_bucket(interval '{step} minutes', min(l)),
        time_bucket(interval '{step} minutes', max(l)), interval {step} minute)) as point from wall group by airport) g
asof join (select * from wall qualify row_number() over (partition by airport, l order by id) = 1) o
  on o.airport = g.airport and o.l <= g.point
left join holidays h on h.airport = g.airport and h.date = o.date
join daily y on y.airport = g.airport and y.date = o.date - 1
join daily k on k.airport = g.airport and k.date = o.date - 7""", "obs", "holidays", extra={"wall": WALL, "daily": DAILY})


def _daily(step: int):
    def features(spark, sf):
        return daily.daily_features(view(spark, sf, "obs"), view(spark, sf, "holidays"), step=step, dummies=["click", "view"])

    query(f"daily_features_{step}min", _daily_sql(step))(features)


_daily(5)
_daily(30)


# --- extension points ----------------------------------------------------------------

@query("custom_predictor", with_views("""
select 'overall' as model, coalesce(cast(horizon_h as varchar), 'ALL') as horizon, count(*) as n, round(avg(abs(y - m)), 6) as mae,
  round(sqrt(avg((y - m) * (y - m))), 6) as rmse, null::double as wql
from (select a.*, p.m from actual a join p_all p using (airport) where a.y is not null)
group by grouping sets ((horizon_h), ())""", "obs", extra=BACKTEST))
def custom(spark, sf):
    """A predictor written by the caller: the key's mean over everything."""

    def overall(history, frame, setup):
        return frame.join(history.groupBy(KEY).agg(F.avg(VALUE).alias("mean")), KEY, "left")

    out = backtest.run_backtest(grid5(spark, sf), setup(spark, sf), {"overall": overall})
    return rounded(out, "mae", "rmse", "wql")


@query("predictor_as_forecast", with_views("""
select airport, slot, round(q[2], 6) as q50 from predicted""", extra={
    **{k: v for k, v in CONTEXT.items()}, "ahead": AHEAD,
    "lparts": profile_views("grid", LOCAL, 5)["parts"],
    **{k: v.replace("from parts", "from lparts") for k, v in QUANTILES.items()}, "predicted": _predicted("ahead", "slot")}))
def as_forecast(spark, sf):
    p = prepared(spark, sf)
    model = forecast.predictor_as_model(models.quantile_profile_model(p.grid).predict)
    out = model(p.context, future_grid(p), FORECAST_LEVELS)
    return rounded(out, "q50").select(KEY, "slot", "q50")


