"""Column functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import AIRLINES, FORECAST_LEVELS, KEY, SITE_NAMES, TS, VALUE
from ..functions import calendar as cal
from ..functions import numbers as num
from ..operators.latest import holiday_flag, name_lookup, number_rows, with_wall_columns
from ..plans.daily import cast_ints
from ..plans.forecast import format_forecast
from ..plans.serving import predict_response, validate_requests
from ..sources.offers import flatten_offers, report_lines
from .catalog import query, r6, rounded
from .tables import table, view, with_views

LOCAL_TS = "((timestamp at time zone 'UTC') at time zone 'Europe/Copenhagen')"
KEYS = ["click", "error", "purchase", "signup", "view"]


def _mapping(spark, names: dict[str, str]):
    return spark.createDataFrame(sorted(names.items()), "code string, name string")


@query("to_local", with_views(f"""
select id, {LOCAL_TS} as wall, (((timestamp + interval 183 day) at time zone 'UTC') at time zone 'Europe/Copenhagen') as wall_summer
from obs""", "obs"))
def to_local(spark, sf):
    obs = view(spark, sf, "obs")
    return obs.select("id", cal.to_local(TS).alias("wall"),
                      cal.to_local(cal.shift(TS, days=183)).alias("wall_summer"))


@query("calendar_features", with_views(f"""
select id, cast(month(l) as int) as month, cast(day(l) as int) as day, cast(isodow(l) - 1 as int) as weekday,
  cast(hour(l) as int) as hour, cast(minute(l) // 5 * 5 as int) as minute,
  cast(isodow(l) >= 6 as int) as is_weekend
from (select id, {LOCAL_TS} as l from obs)""", "obs"))
def calendar_features(spark, sf):
    out = cal.calendar_features(view(spark, sf, "obs"))
    return out.select("id", "month", "day", "weekday", "hour", "minute", "is_weekend")


@query("cyclical_features", with_views(f"""
select id, round(sin(2 * pi() * hour(l) / 24.0), 6) as hour_sin, round(cos(2 * pi() * hour(l) / 24.0), 6) as hour_cos,
  round(sin(2 * pi() * (isodow(l) - 1) / 7.0), 6) as dow_sin, round(cos(2 * pi() * (isodow(l) - 1) / 7.0), 6) as dow_cos,
  round(sin(2 * pi() * (hour(l) * 60 + minute(l)) / 1440.0), 6) as tod_sin,
  round(cos(2 * pi() * (hour(l) * 60 + minute(l)) / 1440.0), 6) as tod_cos
from (select id, {LOCAL_TS} as l from obs)""", "obs"))
def cyclical_features(spark, sf):
    names = [f"{p}_{w}" for p in ("hour", "dow", "tod") for w in ("sin", "cos")]
    return rounded(cal.cyclical_features(view(spark, sf, "obs")), *names).select("id", *names)


CLOCK_SQL = """
  cast(hour(t) as double) as hour, cast(minute(t) as double) as minute,
  cast(isodow(t) - 1 as double) as day_of_week, cast(cast(isodow(t) >= 6 as int) as double) as is_weekend,
  cast(month(t) as double) as month,
  round(sin(2 * pi() * (hour(t) * 60 + minute(t)) / 1440.0), 6) as tod_sin,
  round(cos(2 * pi() * (hour(t) * 60 + minute(t)) / 1440.0), 6) as tod_cos,
  round(sin(2 * pi() * ((isodow(t) - 1) * 1440 + hour(t) * 60 + minute(t)) / 10080.0), 6) as tow_sin,
  round(cos(2 * pi() * ((isodow(t) - 1) * 1440 + hour(t) * 60 + minute(t)) / 10080.0), 6) as tow_cos,
  round(sin(2 * pi() * dayofyear(t) / 365.25), 6) as doy_sin,
  round(cos(2 * pi() * dayofyear(t) / 365.25), 6) as doy_cos"""
WAVES = ["tod_sin", "tod_cos", "tow_sin", "tow_cos", "doy_sin", "doy_cos"]
CLOCK = ["hour", "minute", "day_of_week", "is_weekend", "month", *WAVES]


@query("time_covariates", with_views(f"select id, {CLOCK_SQL} from (select id, timestamp as t from obs)", "obs"))
def time_covariates(spark, sf):
    return rounded(cal.time_covariates(view(spark, sf, "obs")), *WAVES).select("id", *CLOCK)


ZONES = "select 'click' as airport, 'Europe/Dublin' as tz union all select 'view', 'Europe/Istanbul'"


@query("wall_columns", with_views("""
select id, cast(year(l) as int) as year, cast(month(l) as int) as month, cast(day(l) as int) as day,
  cast(hour(l) as int) as hour, cast(isodow(l) - 1 as int) as weekday, cast(l as date) as date
from (select o.id, (o.timestamp at time zone 'UTC') at time zone coalesce(z.tz, 'Europe/Copenhagen') as l
      from obs o left join zones z using (airport))""", "obs", extra={"zones": ZONES}))
def wall_columns(spark, sf):
    out = with_wall_columns(view(spark, sf, "obs"), spark.sql(ZONES))
    return out.select("id", "year", "month", "day", "hour", "weekday", "date")


@query("holiday_flag", with_views(f"""
select o.id, cast(h.date is not null as int) as holiday
from (select *, cast({LOCAL_TS} as date) as d from obs) o
left join holidays h on o.airport = h.airport and o.d = h.date""", "obs", "holidays"))
def holiday(spark, sf):
    obs = view(spark, sf, "obs").withColumn("date", F.to_date(cal.to_local(TS)))
    return holiday_flag(obs, view(spark, sf, "holidays")).select("id", "holiday")


@query("one_hot", with_views("select id, " + ", ".join(
    f"cast(airport = '{k}' as int) as is_{k}" for k in KEYS) + " from obs", "obs"))
def one_hot(spark, sf):
    return view(spark, sf, "obs").select("id", *[c.alias(n) for n, c in num.one_hot(KEY, KEYS, "is_").items()])


@query("categorical_code", with_views("""
select id, case airport when 'click' then 0 when 'view' then 1 when 'error' then 2 end as code from obs""", "obs"))
def categorical_code(spark, sf):
    return view(spark, sf, "obs").select("id", num.categorical_code(KEY, ["click", "view", "error"]).alias("code"))


@query("non_crossing_quantiles", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, s[1] as q10, s[2] as q50, s[3] as q90 from (
  select *, list_sort([greatest(l_quantity - 25, 0), greatest(l_discount * 100 - 2, 0), greatest(l_tax * 500 - 10, 0)]) as s
  from lineitem)""")
def non_crossing(spark, sf):
    q = [F.col("l_quantity") - 25, F.col("l_discount") * 100 - 2, F.col("l_tax") * 500 - 10]
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        *[c.alias(n) for n, c in zip(["q10", "q50", "q90"], num.non_crossing(q))])


@query("quantile_names", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity as q1, l_extendedprice as q10, l_discount as q50, l_tax as q95
from lineitem""")
def quantile_names(spark, sf):
    given = dict(zip([0.01, 0.1, 0.5, 0.95], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                               *[F.col(c).alias(num.quantile_name(q)) for q, c in given.items()])


_MAPPED = {0.05: "value / 4", 0.1: "value / 3", 0.3: "case when event_id % 3 = 0 then null else value / 2 end",
           0.5: "value", 0.7: "value * 2"}


@query("quantile_map", """
select event_id as id, k as quantile, v as amount from (
  select event_id, unnest(['0.05', '0.1', '0.3', '0.5', '0.7', 'q30', 'q70']) as k,
    unnest([round(value / 4, 6), round(value / 3, 6), case when event_id % 3 <> 0 then round(value / 2, 6) end, round(value, 6),
      round(value * 2, 6), case when event_id % 3 <> 0 then round(value / 2, 6) end, round(value * 2, 6)]) as v
  from events) where v is not null""")
def quantile_map(spark, sf):
    pairs = {q: r6(F.expr(e)) for q, e in _MAPPED.items()}
    return table(spark, sf, "events").select(F.col("event_id").alias("id"),
                                             F.explode(num.quantile_map(pairs)).alias("quantile", "amount"))


@query("format_forecast", """
select event_type as airport, event_id as id, ts as timestamp, strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso,
  case when event_id % 4 <> 0 then value end as mean, value / 2 as low, case when event_id % 5 <> 0 then value * 2 end as high,
  case when event_id % 5 <> 0 then 4 else 2 end as n_levels
from events""")
def formatted(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias(KEY), "event_id", F.col("ts").alias("slot"),
        F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("predictions"), (F.col("value") / 2).alias("q30"),
        F.when(F.col("event_id") % 5 != 0, F.col("value") * 2).alias("q70"))
    keyed = rows.withColumn(KEY, F.concat_ws("#", KEY, "event_id"))
    out = format_forecast(keyed, FORECAST_LEVELS)
    parts = F.split(KEY, "#")
    return out.select(F.get(parts, F.lit(0)).alias(KEY), F.get(parts, F.lit(1)).cast("bigint").alias("id"), TS, "iso",
                      "mean", F.try_element_at("quantiles", F.lit("q30")).alias("low"),
                      F.try_element_at("quantiles", F.lit("0.7")).alias("high"), F.size("quantiles").alias("n_levels"))


_CODES = ",".join(k.upper() for k in KEYS)
_EXAMPLE = "e.g., /predict?airport=ARN&timestamp=YYYY-MM-DDTHH:MM"
VALIDATED = f"""
select request_id, case when error is null then upper(airport) else airport end as airport, timestamp, error,
  case when error is null then 200 else 400 end as status,
  case when error is null then try_cast(timestamp as timestamp) end as at
from (select *, case
  when coalesce(timestamp, '') = '' and coalesce(airport, '') = '' then 'Missing "airport" and "timestamp". {_EXAMPLE}'
  when coalesce(timestamp, '') = '' then 'Missing "timestamp". {_EXAMPLE}'
  when coalesce(airport, '') = '' then 'Missing "airport". {_EXAMPLE}'
  when upper(airport) not in ({", ".join(repr(k.upper()) for k in KEYS)})
    then 'Invalid airport code "' || upper(airport) || '". Valid codes: {_CODES}.'
  when try_cast(timestamp as timestamp) is null then 'Invalid "timestamp". Expected YYYY-MM-DDTHH:MM (UTC)' end as error
  from requests)"""


@query("validate_requests", with_views(VALIDATED, "requests"))
def validated(spark, sf):
    return validate_requests(view(spark, sf, "requests"), KEYS)


@query("predict_response", with_views("""
select id, cast(round_even(queue, 0) as int) as predicted_queue_length_minutes,
  round_even(cast(queue / 2 as decimal(18, 6)), 1)::double as p10, round_even(cast(queue as decimal(18, 6)), 1)::double as p50,
  round_even(cast(queue * 2 as decimal(18, 6)), 1)::double as p90, strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ') as answered_for
from obs""", "obs"))
def response(spark, sf):
    q = F.col(VALUE)
    rows = view(spark, sf, "obs").select("id", F.col(TS).alias("at"), (q / 2).alias("q10"), q.alias("q50"), (q * 2).alias("q90"))
    return predict_response(rows).drop("at")


@query("parse_utc", """
select event_id as id, case event_id % 4
    when 0 then date_trunc('second', ts) when 1 then date_trunc('second', ts)
    when 2 then date_trunc('second', ts) - interval 2 hour
    else date_trunc('second', ts) + interval 90 minute end as at
from events""")
def parse_utc(spark, sf):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    form = F.col("event_id") % 4
    given = (F.when(form == 0, text).when(form == 1, F.concat(text, F.lit("Z")))
             .when(form == 2, F.concat(text, F.lit("+0200"))).otherwise(F.concat(text, F.lit("-01:30"))))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), cal.parse_utc(given).alias("at"))


@query("hhmm", "select event_id as id, strftime(ts, '%H:%M') as hhmm from events")
def hhmm(spark, sf):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    given = F.when(F.col("event_id") % 2 == 0, text).otherwise(F.concat(text, F.lit("Z")))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), cal.hhmm(given).alias("hhmm"))


@query("severity", with_views("""
select pull_id, case when queue >= 20 then 'red' when queue >= 10 then 'yellow' else 'green' end as queue_band,
  case when duration_s >= 15 then 'red' when duration_s >= 5 then 'yellow' else 'green' end as duration_band,
  case when duration_s >= 10 then 'red' when duration_s >= 6 then 'yellow' else 'green' end as age_band,
  case when queue / 200 >= 0.99 then 'green' when queue / 200 >= 0.9 then 'yellow' else 'red' end as rate_band,
  case when (pull_id % 3) >= 1 then 'red' else 'green' end as failure_band
from pulls""", "pulls"))
def severity(spark, sf):
    return view(spark, sf, "pulls").select(
        "pull_id", num.severity(VALUE, "queue").alias("queue_band"), num.severity("duration_s", "duration").alias("duration_band"),
        num.severity("duration_s", "minutes_since_pull").alias("age_band"),
        num.severity(F.col(VALUE) / 200, "success_rate").alias("rate_band"),
        num.severity(F.col("pull_id") % 3, "failures").alias("failure_band"))


@query("trend", with_views("""
select id, round(coalesce(f - c, 0.0), 6) as change,
  case when coalesce(f - c, 0.0) > 0.5 then 'up' when coalesce(f - c, 0.0) < -0.5 then 'down' else 'flat' end as arrow
from (select id, queue as c, case when id % 6 = 0 then null when id % 2 = 0 then queue + 0.4 else 60.0 end as f from obs)""",
                           "obs"))
def trend(spark, sf):
    last = F.when(F.col("id") % 6 == 0, None).when(F.col("id") % 2 == 0, F.col(VALUE) + 0.4).otherwise(60.0)
    change = num.trend(VALUE, last)
    return view(spark, sf, "obs").select("id", r6(change).alias("change"), num.trend_arrow(change).alias("arrow"))


@query("airline_names", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, code, coalesce(n.name, code) as airline from ("
       "select *, case l_linenumber % 4 when 0 then 'LH' when 1 then 'U2' when 2 then 'TK' else l_returnflag || l_linestatus end"
       " as code from lineitem) left join (values " + ", ".join(f"('{k}', '{v}')" for k, v in AIRLINES.items()) +
       ") n(code, name) using (code)")
def airline_names(spark, sf):
    n = F.col("l_linenumber") % 4
    code = F.when(n == 0, "LH").when(n == 1, "U2").when(n == 2, "TK").otherwise(F.concat("l_returnflag", "l_linestatus"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", code.alias("code"))
    return name_lookup(rows, _mapping(spark, AIRLINES), "code", "airline")


@query("site_names", with_views("select payload_id, airport, coalesce(n.name, airport) as site from payloads left join (values " +
                                ", ".join(f"('{k}', '{v}')" for k, v in SITE_NAMES.items()) +
                                ") n(airport, name) using (airport)", "payloads"))
def site_names(spark, sf):
    rows = view(spark, sf, "payloads").select("payload_id", KEY)
    return name_lookup(rows, _mapping(spark, SITE_NAMES), KEY, "site")


@query("report_lines", with_views("""
select offer_id, n as number, lpad(cast(n as varchar), cast(length(cast(total as varchar)) as int), '0') as num,
  lpad(cast(n as varchar), cast(length(cast(total as varchar)) as int), '0') || '. ' || origin || ' : ' || destination || ' - '
  || price || ' DKK - ' || substr(dep, 12, 5) as line
from (select *, row_number() over (order by dep, offer_id, price) as n, count(*) over () as total from (
  select offer_id, json_extract_string(offer, '$.itineraries[0].segments[0].departure.iataCode') as origin,
    json_extract_string(offer, '$.itineraries[0].segments[0].departure.at') as dep,
    coalesce(json_extract_string(offer, '$.itineraries[0].segments[1].arrival.iataCode'),
             json_extract_string(offer, '$.itineraries[0].segments[0].arrival.iataCode')) as destination,
    json_extract_string(offer, '$.price.total') as price from offers))""", "offers"))
def report(spark, sf):
    flat = flatten_offers(view(spark, sf, "offers"), keep=["offer_id"]).select(
        "offer_id", "origin", "destination", "price", "currency", "time_iso")
    return report_lines(number_rows(flat, "time_iso", "offer_id", "price")).select("offer_id", "number", "num", "line")


@query("cast_ints", with_views("""
select id, cast(trunc(queue) as bigint) as queue, cast(round_even(half, 0) as bigint) as half
from (select id, queue, floor(queue) + 0.5 as half from obs)""", "obs"))
def casted(spark, sf):
    rows = view(spark, sf, "obs").select("id", VALUE, (F.floor(VALUE) + 0.5).alias("half"))
    return cast_ints(rows, [VALUE], ["half"])


@query("horizon_remaining", with_views("""
select id, cast(trunc(m) as int) as minutes_left, greatest(1, cast(floor(m / 60.0 + 0.5) as int)) as hours_left
from (select id, (epoch_us(timestamp) - epoch_us(timestamp '2024-01-15 06:00:00')) / 60000000.0 as m from obs)""", "obs"))
def remaining(spark, sf):
    at = "2024-01-15 06:00:00"
    return view(spark, sf, "obs").select("id", cal.minutes_remaining(TS, at).alias("minutes_left"),
                                         cal.hours_remaining(TS, at).alias("hours_left"))
