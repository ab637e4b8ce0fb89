"""Latest rows, grids, gaps, context, offers and series over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import COVARIATE_COLUMNS, KEY, TS, VALUE
from ..functions.calendar import shift
from ..functions.numbers import smoothstep
from ..operators import context, grid as grids, latest, live
from ..operators.dedup import dedup_offers
from ..operators.profiles import build_profiles
from ..sources.observations import latest_moment, scan_obs
from ..sources.offers import flatten_offers
from .aggregates import POINTS, points
from .catalog import query, r6, rounded
from .joins import G15, grid15
from .reading import profile_views
from .scalars import CLOCK_SQL, WAVES
from .tables import table, view, with_views


@query("latest_per_key", with_views("""
select id, timestamp, airport, queue from obs
qualify row_number() over (partition by airport order by id desc) = 1""", "obs"))
def newest(spark, sf):
    return latest.latest_per_key(view(spark, sf, "obs"))


LAST24 = """
select id, timestamp, airport, queue, cast(row_number() over (partition by airport order by id desc) as int) as rn from obs
qualify rn <= 24"""


@query("last_n_per_key", with_views(LAST24 + " order by airport, timestamp", "obs"))
def last_rows(spark, sf):
    return latest.last_n_per_key(view(spark, sf, "obs"), 24).orderBy(KEY, TS)


# Readings moved onto whole minutes, so that timestamps repeat within a key.
MINUTES = "select id, date_trunc('minute', timestamp) as timestamp, airport, queue from obs"


def minutes(spark, sf):
    return view(spark, sf, "obs").withColumn(TS, F.date_trunc("minute", TS).cast("timestamp_ntz"))


@query("drop_duplicate_ts", with_views("""
select id, timestamp, airport, queue from minutes qualify row_number() over (partition by airport, timestamp order by id) = 1
""", "obs", extra={"minutes": MINUTES}))
def dedup_ts(spark, sf):
    return grids.drop_duplicate_ts(minutes(spark, sf))


def _resampled(step: int) -> str:
    return with_views(f"""
select g.airport, g.at as timestamp, o.id, o.queue
from (select airport, unnest(generate_series(time_bucket(interval '{step} minutes', min(timestamp)),
        time_bucket(interval '{step} minutes', max(timestamp)), interval {step} minute)) as at from obs group by airport) g
asof join obs o on o.airport = g.airport and o.timestamp <= g.at""".replace("as at", 'as "at"').replace("g.at", 'g."at"'), "obs")


@query("resample_ffill_5min", _resampled(5))
def resample5(spark, sf):
    return grids.resample_ffill(view(spark, sf, "obs"), 5)


@query("resample_ffill_30min", _resampled(30))
def resample30(spark, sf):
    return grids.resample_ffill(view(spark, sf, "obs"), 30)


@query("regular_grid", with_views("""
select d.airport, d.slot, round(g.queue, 6) as queue
from (select airport, unnest(generate_series(min(slot), max(slot), interval 15 minute)) as slot from grid group by airport) d
left join grid g using (airport, slot)""", "obs", extra=G15))
def dense(spark, sf):
    return rounded(grids.regular_grid(grid15(spark, sf), 15), VALUE)


NEXT = "select *, lead(slot) over (partition by airport order by slot) as nxt from grid"


@query("gap_runs", with_views("""
select airport, slot + interval 15 minute as start, nxt as stop,
  cast((epoch(nxt) - epoch(slot)) / 900 - 1 as int) as length
from steps where nxt > slot + interval 15 minute""", "obs", extra={**G15, "steps": NEXT}))
def gaps(spark, sf):
    return context.gap_runs(grid15(spark, sf), 15)


def fill_views(source: str = "grid", max_gap: int = 3) -> dict[str, str]:
    """SQL for bridging, slot by slot: every missing slot looks left and right."""
    expect = ("coalesce((select m from p_slot s where s.airport = {a} and s.weekday = isodow({t}) - 1 and s.hour = hour({t})"
              " and s.minute = minute({t})), (select m from p_time s where s.airport = {a} and s.hour = hour({t})"
              " and s.minute = minute({t})), (select m from p_all s where s.airport = {a}), 0.0)")
    return {
        "edges": f"select *, lead(slot) over w as nxt, lead(queue) over w as nxt_queue from {source} "
                 "window w as (partition by airport order by slot)",
        "holes": f"""select airport, slot as low, nxt as high, queue as low_q, nxt_queue as high_q,
            (epoch(nxt) - epoch(slot)) / 900 - 1 as gap,
            unnest(generate_series(slot + interval 15 minute, nxt - interval 15 minute, interval 15 minute)) as slot
            from edges where nxt > slot + interval 15 minute and (epoch(nxt) - epoch(slot)) / 900 - 1 <= {max_gap}""",
        "expected": f"""select h.*, {expect.format(a='h.airport', t='h.slot')} as p,
            h.low_q - {expect.format(a='h.airport', t='h.low')} as r0,
            h.high_q - {expect.format(a='h.airport', t='h.high')} as r1 from holes h""",
        "bridged": f"""select airport, slot, queue, false as filled from {source} union all
            select airport, slot, greatest(0.0, p + r0 + (r1 - r0) * ((epoch(slot) - epoch(low)) / 900) / (gap + 1)), true
            from expected""",
    }


@query("seasonal_fill", with_views("select airport, slot, round(queue, 9) as queue, filled from bridged", "obs",
                                   extra={**G15, **profile_views("grid", "slot", 1), **fill_views()}))
def filled(spark, sf):
    grid = grid15(spark, sf)
    return rounded(context.seasonal_fill(grid, build_profiles(grid, None, 1), 15, 3), VALUE, digits=9)


@query("latest_segment", with_views("""
select airport, slot, round(queue, 6) as queue from steps s
where slot >= coalesce((select max(b.nxt) from steps b where b.airport = s.airport and b.nxt > b.slot + interval 30 minute),
  (select min(b.slot) from steps b where b.airport = s.airport))""", "obs", extra={**G15, "steps": NEXT}))
def segment(spark, sf):
    out = context.latest_segment(context.with_gaps(grid15(spark, sf), 15), 1)
    return rounded(out, VALUE).select(KEY, "slot", VALUE)


# --- the forecaster's context --------------------------------------------------

# A raw feed in which keys fail in different ways: one stale, one short, one unreadable, one absent.
RAW = """
select event_id as id, ts as timestamp,
  case when event_type = 'signup' and ts > timestamp '2024-01-28' then 'other' when event_type = 'error' and
    ts < timestamp '2024-01-30 12:00:00' then 'other' when event_type = 'error' then 'short' else event_type end as airport,
  case when event_type = 'purchase' then null when event_id % 97 = 0 then -1 else value end as queue
from events
where not (event_type = 'click' and hour(ts) between 2 and 7 and day(ts) = 20)"""
ALL_KEYS = "select distinct airport from raw union all select 'absent'"
CONTEXT = {
    "raw": RAW,
    "clean": "select airport, timestamp, queue from raw where queue >= 0",
    "grid": G15["grid"],
    **profile_views("grid", "slot", 1),
    "now": "select max(timestamp) as now_ts from raw",
    "recent": "select * from (select *, max(slot) over (partition by airport) as top from grid) "
              "where slot >= top - interval 20 day",
    **fill_views("recent", 8),
    "breaks": """select airport, min(slot) as first_slot, max(slot) as last_slot, count(*) as observed,
        coalesce(max(nxt) filter ((epoch(nxt) - epoch(slot)) / 900 - 1 > 8), min(slot)) as seg from edges group by airport""",
    "fills": "select airport, count(*) as filled, max(gap) as longest from expected group by airport",
    "tallies": """select airport, count(*) as raw_rows, count(*) filter (queue >= 0) as valid_rows,
        count(*) filter (queue < 0) as negative_sentinel_rows from raw group by airport""",
    "flat": f"""select k.airport, coalesce(t.raw_rows, 0) as raw_rows, coalesce(t.valid_rows, 0) as valid_rows,
        coalesce(t.negative_sentinel_rows, 0) as negative_sentinel_rows, b.*exclude(airport),
        coalesce(cast((epoch(last_slot) - epoch(first_slot)) / 900 + 1 as bigint), 0) as grid_rows,
        coalesce(cast((epoch(last_slot) - epoch(seg)) / 900 + 1 as bigint), 0) as seg_rows,
        coalesce(f.filled, 0) as filled, coalesce(f.longest, 0) as longest,
        (epoch_us(n.now_ts) - epoch_us(last_slot)) / 60000000.0 as age,
        (select count(*) from recent r where r.airport = k.airport and r.slot >= b.seg) as kept
        from ({ALL_KEYS}) k left join tallies t using (airport) left join breaks b using (airport)
        left join fills f using (airport), now n""",
    "stats": """select *, case when raw_rows = 0 then 'no_rows' when valid_rows = 0 then 'no_valid_rows'
        when age > 360 then 'stale_history' when seg_rows < 64 then 'insufficient_history' else 'ok' end as status from flat""",
}


def raw(spark, sf):
    kind, ts, n = F.col("event_type"), F.col("ts"), F.col("event_id")
    key = (F.when((kind == "signup") & (ts > F.lit("2024-01-28").cast("timestamp_ntz")), "other")
           .when((kind == "error") & (ts < F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")), "other")
           .when(kind == "error", "short").otherwise(kind))
    queue = F.when(kind != "purchase", F.when(n % 97 == 0, -1.0).otherwise(F.col("value")))
    return (table(spark, sf, "events").where(~((kind == "click") & F.hour("ts").between(2, 7) & (F.dayofmonth("ts") == 20)))
            .select(n.alias("id"), ts.alias(TS), key.alias(KEY), queue.alias(VALUE)))


def prepared(spark, sf):
    rows = raw(spark, sf)
    keys = rows.select(KEY).distinct().unionByName(spark.range(1).select(F.lit("absent").alias(KEY)))
    return context.prepare_context(rows, latest_moment(rows), keys=keys, days=20, max_gap=8)


@query("context_stats", with_views("""
select airport, raw_rows, valid_rows, negative_sentinel_rows, grid_rows - coalesce(observed, 0) as rows_needing_fill,
  coalesce(observed, 0) as rows_not_needing_fill, filled as rows_seasonally_filled,
  cast(longest as int) as longest_gap_filled_steps, grid_rows - coalesce(observed, 0) - filled as rows_missing_after_fill,
  case when age <= 360 then seg_rows else 0 end as context_rows,
  round(case when seg_rows > 0 then 1.0 - kept / seg_rows else 0 end, 6) as context_synthetic_ratio,
  cast(floor(age) as int) as context_age_minutes, 20 as window_days, last_slot - interval 20 day as window_start,
  last_slot as window_end, grid_rows as window_grid_rows, coalesce(observed, 0) as window_observed_rows,
  round(case when grid_rows > 0 then observed / grid_rows else 0 end, 6) as window_coverage_ratio,
  seg as selected_segment_start, last_slot as selected_segment_end, status,
  case status when 'no_rows' then 'No rows found for airport' when 'no_valid_rows' then 'No valid queue history after cleanup'
    when 'stale_history' then 'Most recent history ends ' || strftime(last_slot, '%Y-%m-%dT%H:%M:%S') || ', '
      || cast(cast(floor(age) as int) as varchar) || ' min ago (limit 360); refusing to forecast an elapsed window'
    when 'insufficient_history' then 'Not enough history after preprocessing: ' || cast(seg_rows as varchar) || ' rows'
    else '' end as status_message
from stats""", extra=CONTEXT))
def stats(spark, sf):
    return rounded(prepared(spark, sf).stats, "context_synthetic_ratio", "window_coverage_ratio")


def covariate_sql(source: str) -> str:
    """SQL for the covariates of a view with (airport, slot)."""
    return f"""
select c.*, {CLOCK_SQL.replace("(t)", "(c.slot)")},
  coalesce(l1.queue, s.m, t.m, a.m) as queue_lag_30d, coalesce(l2.queue, s.m, t.m, a.m) as queue_lag_365d,
  coalesce(s.m, t.m, a.m) as queue_avg_dow_time, coalesce(t.m, a.m) as queue_avg_time
from {source} c
left join grid l1 on l1.airport = c.airport and l1.slot = c.slot - interval 30 day
left join grid l2 on l2.airport = c.airport and l2.slot = c.slot - interval 365 day
left join p_slot s on s.airport = c.airport and s.weekday = isodow(c.slot) - 1 and s.hour = hour(c.slot) and s.minute = minute(c.slot)
left join p_time t on t.airport = c.airport and t.hour = hour(c.slot) and t.minute = minute(c.slot)
left join p_all a on a.airport = c.airport"""


LOOKUPS = ["queue_lag_30d", "queue_lag_365d", "queue_avg_dow_time", "queue_avg_time"]
USABLE = "select b.* from bridged b join stats s on s.airport = b.airport and s.status = 'ok' and b.slot >= s.seg"
AHEAD = """
select airport, unnest(generate_series(last_slot + interval 15 minute, last_slot + interval 480 minute, interval 15 minute)) as slot
from stats where status = 'ok'"""
_ROUND = ", ".join(f"round({c}, 9) as {c}" for c in LOOKUPS)


@query("prepare_context", with_views(f"select * replace(round(queue, 9) as queue, {_ROUND}) from cov", extra={
    **CONTEXT, "usable": USABLE, "cov": covariate_sql("usable")}))
def prepare(spark, sf):
    out = rounded(rounded(prepared(spark, sf).context, *WAVES), VALUE, *LOOKUPS, digits=9)
    return out.select(KEY, "slot", VALUE, "filled", *COVARIATE_COLUMNS)


@query("future_grid", with_views(f"select * replace({_ROUND}) from cov", extra={
    **CONTEXT, "ahead": AHEAD, "cov": covariate_sql("ahead")}))
def future(spark, sf):
    out = rounded(rounded(context.future_grid(prepared(spark, sf)), *WAVES), *LOOKUPS, digits=9)
    return out.select(KEY, "slot", *COVARIATE_COLUMNS)


# --- offers ---------------------------------------------------------------------

FLAT = """
select offer_id, json_extract_string(offer, '$.itineraries[0].segments[0].departure.iataCode') as origin,
  coalesce(json_extract_string(offer, '$.itineraries[0].segments[1].arrival.iataCode'),
           json_extract_string(offer, '$.itineraries[0].segments[0].arrival.iataCode')) as destination,
  json_extract_string(offer, '$.itineraries[0].segments[0].carrierCode') as carrier,
  json_extract_string(offer, '$.itineraries[0].segments[0].carrierCode')
    || json_extract_string(offer, '$.itineraries[0].segments[0].number') as flight,
  json_extract_string(offer, '$.price.total') as price, cast(json_extract_string(offer, '$.price.total') as double) as price_value,
  json_extract_string(offer, '$.price.currency') as currency,
  json_extract_string(offer, '$.itineraries[0].segments[0].departure.at') as time_iso,
  cast(json_extract_string(offer, '$.itineraries[0].segments[0].departure.at') as timestamp) as departs,
  cast(json_extract(offer, '$.numberOfBookableSeats') as int) as seats
from offers"""


@query("flatten_offers", with_views(FLAT, "offers"))
def flattened(spark, sf):
    return flatten_offers(view(spark, sf, "offers"), keep=["offer_id"])


# The ordered scan in SQL: one list of kept offers per route, grown in price order.
@query("dedup_offers", with_views("""
select offer_id, origin, destination, departs, seats, price_value from (
  select origin, destination, unnest(list_reduce(ordered, lambda kept, o: case when len(list_filter(kept, lambda k:
      abs(epoch(k.departs) - epoch(o[1].departs)) <= 1200 and abs(k.seats - o[1].seats) <= 2)) > 0 then kept
      else list_concat(kept, o) end), recursive := true)
  from (select origin, destination, list_prepend([]::struct(offer_id varchar, departs timestamp, seats int, price_value double)[],
      list([{'offer_id': offer_id, 'departs': departs, 'seats': seats, 'price_value': price_value}]
        order by price_value, offer_id)) as ordered from flat group by all))""", "offers", extra={"flat": FLAT}))
def deduplicated(spark, sf):
    flat = flatten_offers(view(spark, sf, "offers"), keep=["offer_id"])
    return dedup_offers(flat.select("offer_id", "origin", "destination", "departs", "seats", "price_value"))


# --- live series ----------------------------------------------------------------

@query("upcoming_points", with_views(
    "select airport, timestamp, round(greatest(mean, 0.0), 6) as mean from points", "obs", extra={**G15, "points": POINTS}))
def upcoming(spark, sf):
    return rounded(points(spark, sf), "mean")


@query("points_within_2h", with_views("""
select airport, timestamp, round(greatest(mean, 0.0), 6) as mean from points
where timestamp <= (select max(timestamp) from obs) + interval 2 hour""", "obs", extra={**G15, "points": POINTS}))
def near_points(spark, sf):
    return rounded(live.within_hours(points(spark, sf), latest_moment(view(spark, sf, "obs"))), "mean")


EASED = """
select p.airport, p.timestamp, round(case when l.airport is null then m
    else greatest(0.0, l.queue * (1 - (3 * t * t - 2 * t * t * t)) + m * (3 * t * t - 2 * t * t * t)) end, 6) as prediction
from (select *, greatest(mean, 0.0) as m, row_number() over w / count(*) over (partition by airport) as t
      from points window w as (partition by airport order by timestamp)) p
left join newest l on l.airport = p.airport"""
NEWEST = "select * from obs where airport <> 'error' qualify row_number() over (partition by airport order by id desc) = 1"


def _newest(spark, sf):
    return latest.latest_per_key(view(spark, sf, "obs")).where(F.col(KEY) != "error").select(
        KEY, F.col(VALUE).alias("effective"))


@query("smoothstep_blend", with_views(EASED, "obs", extra={**G15, "points": POINTS, "newest": NEWEST}))
def blend(spark, sf):
    return rounded(live.blended(points(spark, sf), _newest(spark, sf)), "prediction").select(KEY, TS, "prediction")


@query("smoothstep", "select event_id as id, round(3 * t * t - 2 * t * t * t, 6) as eased "
                     "from (select event_id, value / 500.0 as t from events)")
def smooth(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("id"),
                                             r6(smoothstep(F.col("value") / 500.0)).alias("eased"))


@query("merge_past_future", with_views("""
select airport, timestamp, past, prediction, part,
  round(case when sum(1 - part) over w > 0 and count(*) over w > 1 then sum(1 - part) over w / (count(*) over w - 1) else 0 end, 6) as past_share
from (
  select p.airport, p.timestamp, case when rn = 1 then coalesce(l.queue, p.queue) else p.queue end as past,
    case when rn = 1 then coalesce(l.queue, p.queue) end as prediction, 0 as part
  from last24 p left join newest l on l.airport = p.airport
  union all select airport, timestamp, null, prediction, 1 from eased)
window w as (partition by airport)""", "obs", extra={
    **G15, "points": POINTS, "newest": NEWEST, "last24": LAST24, "eased": EASED}))
def merged(spark, sf):
    past = latest.last_n_per_key(view(spark, sf, "obs"), 24)
    out = live.merge_past_future(past, points(spark, sf), _newest(spark, sf))
    return out.withColumns({"prediction": r6("prediction"), "past_share": r6("past_share")})


# --- sort and limit --------------------------------------------------------------

@query("order_and_limit", with_views("""
select id, airport, timestamp, queue from obs order by timestamp desc, id limit 1000""", "obs"))
def top(spark, sf):
    return scan_obs(view(spark, sf, "obs"), columns=["id", "airport", "timestamp", "queue"],
                    order=[F.desc(TS), "id"], limit=1000)


@query("concatenated_keys", with_views("""
select airport, slot, queue, 'observed' as part from (select airport, slot, round(queue, 6) as queue from grid)
union all select airport, slot + interval 7 day, round(queue, 6), 'week_ahead' from grid""", "obs", extra=G15))
def concatenated(spark, sf):
    grid = rounded(grid15(spark, sf), VALUE)
    return grid.withColumn("part", F.lit("observed")).unionByName(
        grid.withColumns({"slot": shift("slot", days=7), "part": F.lit("week_ahead")}))


