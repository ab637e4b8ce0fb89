"""Scans, cleaning and the feed rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import KEY
from ..operators.grid import grid_average
from ..operators.profiles import build_profiles, profile_lookup
from ..sources import feeds, observations as obs_source, offers as offer_source
from ..sources.arrays import write_array
from ..session import delete, input_bytes, scratch_path, shuffles_dropped
from .catalog import query, r6, rounded
from .tables import table, view, with_views

LIST_SHARE = 16 << 20  # bytes of the tables, for each core, whose lists are on disk at a time

# --- the flagship -------------------------------------------------------------

CLEAN = """
select airport, timestamp, queue from obs where queue is not null and queue >= 0 and queue < 1e10
"""
GRID15 = """
select airport, time_bucket(interval '15 minutes', timestamp) as slot, avg(queue) as queue
from clean group by all
"""
GRID5 = GRID15.replace("15 minutes", "5 minutes")


def profile_views(grid: str, local: str, bucket: int) -> dict[str, str]:
    """SQL for the three profile levels of a grid view; ``local`` is its wall time."""
    return {
        "parts": f"""select airport, slot, queue, cast(isodow({local}) - 1 as int) as weekday,
            cast(hour({local}) as int) as hour,
            cast(floor(minute({local}) / {bucket}) * {bucket} as int) as minute from {grid}""",
        "p_slot": "select airport, weekday, hour, minute, avg(queue) as m from parts group by all",
        "p_time": "select airport, hour, minute, avg(queue) as m from parts group by all",
        "p_all": "select airport, avg(queue) as m from parts group by all",
    }


LOCAL = "((slot at time zone 'UTC') at time zone 'Europe/Copenhagen')"


@query("expected_vs_observed", with_views("""
select g.airport, g.slot, round(g.queue, 6) as observed,
       round(coalesce(s.m, t.m, a.m, 0.0), 6) as expected,
       round(g.queue - coalesce(s.m, t.m, a.m, 0.0), 6) as residual
from parts g left join p_slot s using (airport, weekday, hour, minute)
left join p_time t using (airport, hour, minute) left join p_all a using (airport)
""", "obs", extra={"clean": CLEAN, "grid": GRID15, **profile_views("grid", "slot", 1)}))
def expected_vs_observed(spark, sf):
    obs = obs_source.clean_obs(view(spark, sf, "obs"), drop_negative=True)
    grid = grid_average(obs, 15)
    out = profile_lookup(grid, build_profiles(grid, tz=None, bucket=1), slot_name="expected", time_name="_t")
    return out.select(KEY, "slot", r6("queue").alias("observed"), r6("expected").alias("expected"),
                      r6(F.col("queue") - F.col("expected")).alias("residual"))


# --- scans and cleaning -------------------------------------------------------

@query("scan_obs", with_views("""
select airport, timestamp, queue from obs
where airport in ('click', 'view') and timestamp >= timestamp '2024-01-05' and timestamp <= timestamp '2024-01-20'
order by timestamp
""", "obs"))
def scan_obs(spark, sf):
    return obs_source.scan_obs(view(spark, sf, "obs"), keys=["click", "view"], since="2024-01-05", until="2024-01-20",
                               columns=["airport", "timestamp", "queue"], order=["timestamp"])


@query("clean_obs", with_views("""
select id, queue, timestamp, airport from obs
where try_cast(raw as double) is not null and try_cast(raw as double) >= 0 and try_cast(raw as double) < 1e10
""", extra={"obs": """
select event_id as id, ts as timestamp, event_type as airport, try_cast(raw as double) as queue, raw
from (select *, case when event_id % 11 = 0 then 'closed' when event_id % 13 = 0 then '1e11'
      when event_id % 97 = 0 then '-1' else cast(value as varchar) end as raw from events)"""}))
def clean_obs(spark, sf):
    raw = table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 11 == 0, "closed").when(F.col("event_id") % 13 == 0, "1e11")
        .when(F.col("event_id") % 97 == 0, "-1").otherwise(F.col("value").cast("string")).alias("queue"),
        F.col("ts").cast("string").alias("timestamp"), F.col("event_type").alias("airport"))
    return obs_source.clean_obs(raw, drop_negative=True)


@query("clean_obs_keep_negative", with_views(
    "select id, timestamp, airport, queue from obs where queue is not null and queue < 1e10", "obs"))
def clean_obs_keep_negative(spark, sf):
    return obs_source.clean_obs(view(spark, sf, "obs"))


@query("history_window", with_views("""
select id, timestamp, airport, queue from obs
where timestamp >= (select max(timestamp) from obs) - interval 14 day
""", "obs"))
def history_window(spark, sf):
    obs = view(spark, sf, "obs")
    return obs_source.history_window(obs, obs_source.latest_moment(obs), days=14)


@query("since_last_n_days", with_views("""
select id, timestamp, airport, queue from obs
where timestamp >= (select max(timestamp) from obs) - interval 365 day
""", "obs"))
def since_last_n_days(spark, sf):
    obs = view(spark, sf, "obs")
    return obs_source.since_last_n_days(obs, obs_source.latest_moment(obs))


@query("completeness", with_views("""
select (select count(*) from obs) as rows, (select max(id) from obs) + 1 as expected_rows,
  case when (select count(*) from obs) < (select max(id) from obs) + 1 then 'truncated' else 'ok' end as status
""", "obs"))
def completeness(spark, sf):
    obs = view(spark, sf, "obs")
    manifest = obs.agg((F.max("id") + 1).alias("expected_rows"))
    return obs_source.completeness(obs, manifest)


@query("load_offers", with_views("""
select order_key, json_extract_string(offer, '$.price.total') as total,
       cast(json_extract(offer, '$.numberOfBookableSeats') as int) as seats
from offers
""", "offers"))
def load_offers(spark, sf):
    """Offers put into one document per order, half of them wrapped, then read back."""
    listed = F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("offer")), ","), F.lit("]"))
    docs = view(spark, sf, "offers").groupBy("order_key").agg(listed.alias("root")).withColumn(
        "value", F.when(F.col("order_key") % 2 == 0, F.col("root")).otherwise(
            F.concat(F.lit('{"data":'), F.col("root"), F.lit("}"))))
    return offer_source.offers_of(docs, keep=["order_key"]).select(
        "order_key", F.col("offer.price.total").alias("total"),
        F.col("offer.numberOfBookableSeats").alias("seats"))


@query("offer_list_files", with_views("""
select json_extract_string(offer, '$.price.total') as total, cast(json_extract(offer, '$.numberOfBookableSeats') as int) as seats
from offers""", "offers"))
def offer_list_files(spark, sf):
    """Offers put into large lists, one a task and as long as its share, written as files, and read back in byte ranges.

    Lists take some fifteen times the room of the tables, so of large tables one share of the
    orders after the other goes through: its lists are deleted when their rows are read.
    """
    offers = view(spark, sf, "offers")
    shares = max(1, -(-input_bytes(offers) // (LIST_SHARE * spark.sparkContext.defaultParallelism)))

    def through_lists(share, path):
        with shuffles_dropped(spark):
            write_array(share, "offer", path)
        return offer_source.load_offers(spark, path, lists=True, cut="\n").select(
            F.col("offer.price.total").alias("total"), F.col("offer.numberOfBookableSeats").alias("seats"))

    if shares == 1:
        return through_lists(offers, scratch_path(spark, "lists"))
    out = scratch_path(spark, "listed")
    for k in range(shares):
        path = scratch_path(spark, "lists")
        listed = through_lists(offers.where(F.pmod(F.xxhash64("order_key"), F.lit(shares)) == k), path)
        listed.write.mode("append").parquet(out)
        delete(spark, path)
    return spark.read.schema(listed.schema).parquet(out)


# --- feed rules ---------------------------------------------------------------

def _int(path: str) -> str:
    return f"try_cast(json_extract_string(payload, '{path}') as bigint)"


def _from_zero(value: str) -> str:
    return f"case when {value} is not null then greatest({value}, 0) end"


def _pick(array: str, test: str, value: str, last: bool) -> str:
    """SQL value of the last (or first) matching element of a JSON array."""
    found = f"list_filter(try_cast(json_extract(payload, '{array}') as json[]), lambda e: {test})"
    element = f"({found})[{-1 if last else 1}]"
    return value.replace("$e", element)


_NORTH, _SUED = (
    f"try_cast(({_pick('$.queueTimes.current', f'''json_extract_string(e, '$.queueId') = '{q}' and cast(json_extract_string(e, '$.projectedWaitTime') as double) > 0''', '''json_extract_string($e, '$.projectedWaitTime')''', True)}) as double)"
    for q in feeds.MUC_QUEUES)
_CPH_NUMS = ("regexp_extract_all(concat_ws(' ', json_extract_string(payload, '$.t2WaitingTimeInterval'), "
             "json_extract_string(payload, '$.t3WaitingTimeInterval')), '\\d+')")
FEED_SQL = {
    "MUC": f"""case when json_extract(payload, '$.queueTimes.current') is not null then coalesce(case when {_NORTH} > 20 and {_SUED} > 20
        then least(greatest(4, round_even({_NORTH} / 60, 0)), greatest(4, round_even({_SUED} / 60, 0)))
        else least(round_even({_NORTH}, 0), round_even({_SUED}, 0)) end, 0) end""",
    "IST": _int("$.result.gateWaitTime"),
    "LHR": "list_filter(list_transform(flatten(list_transform(try_cast(payload as json[]), lambda t: "
           "try_cast(json_extract(t, '$.queueMeasurements') as json[]))), lambda m: case when "
           "json_extract_string(m, '$.name') = 'maximumWaitTime' then "
           "try_cast(json_extract_string(m, '$.value') as bigint) end), lambda v: v is not null)[-1]",
    "FRA": "try_cast(regexp_extract(" + _pick(
        "$.data", "json_extract_string(e, '$.ps') = 'Security checkpoint, Concourse A' || chr(13) || chr(10) || "
        "'Departure gates: A1 - A69'", "json_extract_string($e, '$.status')", False) + ", '\\d+') as bigint)",
    "DUS": "try_cast(" + _pick("$.data", "json_extract_string(e, '$.name') = 'Sicherheitskontrolle A'",
                               "json_extract_string($e, '$.waitingTime')", True) + " as bigint)",
    "CPH": f"round_even(list_avg(list_transform({_CPH_NUMS}, lambda x: cast(x as double))), 0)",
    "ARN": "try_cast(regexp_extract(" + _pick("$.queueTimesList",
                                              "json_extract_string(e, '$.locationName') = 'Terminal 5'",
                                              "json_extract_string($e, '$.interval')", True) + ", '\\d+') as bigint)",
    "DUB": _from_zero("try_cast(trim(json_extract_string(payload, '$.T1'), '= ') as bigint)"),
    "EDI": _from_zero(_int("$.minutes")),
    "OSL": _from_zero(_int("$.timeMinutesRounded")),
    "AMS": _from_zero(f"floor({_int('$.VF1.waitTimeInSeconds')} / 60.0)"),
}
OUTCOMES = """
select payload_id, airport, timestamp, queue,
  case when queue is not null then 'success' when airport = 'EDI' then 'skipped' else 'failure' end as status
from (select payload_id, airport, fetched_at as timestamp, cast(case """ + " ".join(
    f"when airport = '{f}' then {e}" for f, e in FEED_SQL.items()) + " end as double) as queue from payloads)"


def _one_feed(feed: str):
    def read(spark, sf):
        return feeds.read_feed(view(spark, sf, "payloads"), feed)

    text = with_views(f"""
select payload_id, airport, timestamp, queue,
  case when queue is not null then 'success' when airport = 'EDI' then 'skipped' else 'failure' end as status
from (select payload_id, airport, fetched_at as timestamp, cast({FEED_SQL[feed]} as double) as queue
      from payloads where airport = '{feed}')""", "payloads")
    query(f"feed_{feed.lower()}", text)(read)


for _feed in feeds.RULES:
    _one_feed(_feed)

BROKEN = """
select payload_id, fetched_at, airport,
  case when payload_id % 5 = 0 and airport <> 'EDI' then '{"closed": true}' else payload end as payload
from payloads"""


@query("normalise_feeds", with_views(
    "select payload_id, airport, timestamp, queue from outcomes where status = 'success'",
    "payloads", extra={"outcomes": OUTCOMES}))
def normalise_feeds(spark, sf):
    return feeds.normalise_feeds(view(spark, sf, "payloads"))


def _broken(spark, sf):
    """Payloads of which every fifth (but EDI's) lost its content."""
    return view(spark, sf, "payloads").withColumn(
        "payload", F.when((F.col("payload_id") % 5 == 0) & (F.col(KEY) != "EDI"), '{"closed": true}')
        .otherwise(F.col("payload")))


@query("pull_outcomes", with_views(
    "select airport, status, count(*) as pulls, round(sum(queue), 6) as queue_sum from outcomes group by all",
    "payloads", extra={"broken": BROKEN, "outcomes": OUTCOMES.replace("from payloads", "from broken")}))
def pull_outcomes(spark, sf):
    out = feeds.pull_outcomes(_broken(spark, sf))
    return out.groupBy(KEY, "status").agg(F.count(F.lit(1)).alias("pulls"), r6(F.sum("queue")).alias("queue_sum"))


@query("feed_quarantine", with_views("""
select payload_id, airport, fetched_at as timestamp, payload as raw from broken
where payload_id % 5 = 0 and airport <> 'EDI'
""", "payloads", extra={"broken": BROKEN}))
def feed_quarantine(spark, sf):
    return feeds.quarantined(_broken(spark, sf))


__all__ = ["CLEAN", "GRID15", "GRID5", "LOCAL", "profile_views", "rounded"]
