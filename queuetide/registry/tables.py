"""The given tables, and the views the queries derive from them.

The view texts use SQL that Spark and DuckDB share, so a query and its SQL twin
start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import name_shared_dir, pin_utc

OBS = """
select event_id as id, ts as timestamp, event_type as airport,
       case when event_id % 97 = 0 then cast(-1 as double) else value end as queue
from events
"""

PULLS = """
select event_id as pull_id, ts as timestamp, event_type as airport,
       case when event_id % 10 = 0 then 'failure' when event_id % 23 = 0 then 'skipped' else 'success' end as status,
       value / 10.0 as duration_s, case when event_id % 23 <> 0 then value end as queue
from events
"""

REQUESTS = """
select event_id as request_id,
       case when event_id % 7 = 2 then null
            when event_id % 7 = 3 then 'ZZZ'
            when event_id % 7 = 4 then upper(event_type) else event_type end as airport,
       case when event_id % 7 = 0 then null
            when event_id % 7 = 1 then 'not-a-date'
            else substr(cast(ts as string), 1, 16) end as timestamp
from events
"""

HOLIDAYS = """
select 'click' as airport, cast('2024-01-01' as date) as date
union all select 'view', cast('2024-01-01' as date)
union all select 'view', cast('2024-01-06' as date)
union all select 'purchase', cast('2024-01-15' as date)
"""

OFFERS = """
select cast(l.l_orderkey as string) || '-' || cast(l.l_linenumber as string) || '-'
         || cast(l.l_partkey as string) || '-' || cast(l.l_suppkey as string) as offer_id,
  l.l_orderkey as order_key,
  '{"numberOfBookableSeats":' || cast(l.l_linenumber as string)
  || ',"price":{"total":"' || cast(cast(l.l_extendedprice as decimal(12,2)) as string)
  || '","currency":"DKK"},"itineraries":[{"segments":[{"carrierCode":"' || l.l_returnflag || l.l_linestatus
  || '","number":"' || cast(l.l_partkey as string) || '","departure":{"iataCode":"' || cn.n_name
  || '","at":"2024-01-0' || cast(1 + l.l_orderkey % 9 as string) || 'T' || lpad(cast(cast(floor(((l.l_orderkey * 7 + l.l_partkey * 11) % 1440) / 60.0) as int) as string), 2, '0')
  || ':' || lpad(cast((l.l_orderkey * 7 + l.l_partkey * 11) % 60 as string), 2, '0') || ':00"},"arrival":{"iataCode":"'
  || case when l.l_linenumber % 2 = 0
          then 'HUB"}},{"carrierCode":"XX","number":"1","departure":{"iataCode":"HUB","at":"2024-01-01T23:59:00"},"arrival":{"iataCode":"'
          else '' end
  || sn.n_name || '"}}]}]}' as offer
from lineitem l
join orders o on l.l_orderkey = o.o_orderkey
join customer c on o.o_custkey = c.c_custkey
join nation cn on c.c_nationkey = cn.n_nationkey
join supplier s on l.l_suppkey = s.s_suppkey
join nation sn on s.s_nationkey = sn.n_nationkey
"""

PAYLOADS = """
select event_id as payload_id, fetched_at, airport,
  case airport
    when 'MUC' then '{"queueTimes":{"current":[{"queueId":"T2_Abflug_SIKO_ECO_NORD","projectedWaitTime":' || v || '},{"queueId":"T2_Abflug_SIKO_ECO_SUED","projectedWaitTime":' || v || '0},{"queueId":"OTHER","projectedWaitTime":1}]}}'
    when 'IST' then '{"result":{"gateWaitTime":' || v || '}}'
    when 'LHR' then '[{"queueMeasurements":[{"name":"minimumWaitTime","value":0},{"name":"maximumWaitTime","value":' || v || '}]}]'
    when 'FRA' then '{"data":[{"ps":"Other","status":"99 min"},{"ps":"Security checkpoint, Concourse A' || chr(92) || 'r' || chr(92) || 'nDeparture gates: A1 - A69","status":"' || v || ' min"}]}'
    when 'DUS' then '{"data":[{"name":"Sicherheitskontrolle A","waitingTime":1},{"name":"Sicherheitskontrolle A","waitingTime":' || v || '}]}'
    when 'CPH' then '{"t2WaitingTimeInterval":"' || v || '-' || v || '0","t3WaitingTimeInterval":' || case when cast(v as int) % 3 = 0 then 'null' else '"> ' || v || ' min"' end || '}'
    when 'ARN' then '{"queueTimesList":[{"locationName":"Terminal 2","interval":"1-2"},{"locationName":"Terminal 5","interval":"' || v || '-99 min"}]}'
    when 'DUB' then '{"T1":"= ' || v || '","T2":"5"}'
    when 'EDI' then case when cast(v as int) % 5 = 0 then '{"queue":1}' else '{"minutes":' || v || '}' end
    when 'OSL' then case when cast(v as int) % 5 = 0 then '{"timeMinutesRounded":-1}' else '{"timeMinutesRounded":' || v || '}' end
    else '{"VF1":{"waitTimeInSeconds":' || v || '7}}' end as payload
from (
  select event_id, ts as fetched_at, cast(cast(floor(value) + 1 as int) as string) as v,
    case event_id % 11 when 0 then 'MUC' when 1 then 'IST' when 2 then 'LHR' when 3 then 'FRA'
      when 4 then 'DUS' when 5 then 'CPH' when 6 then 'ARN' when 7 then 'DUB' when 8 then 'EDI'
      when 9 then 'OSL' else 'AMS' end as airport
  from events) e
"""

VIEWS = {
    "obs": (OBS, ["events"]),
    "pulls": (PULLS, ["events"]),
    "requests": (REQUESTS, ["events"]),
    "holidays": (HOLIDAYS, []),
    "offers": (OFFERS, ["lineitem", "orders", "customer", "nation", "supplier"]),
    "payloads": (PAYLOADS, ["events"]),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    pin_utc(spark)
    name_shared_dir(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, inputs = VIEWS[name]
    for position, source in enumerate(inputs):
        df = table(spark, sf_dir, source)
        # Both build or parse JSON row by row, so the rows are dealt out by their key first.
        heavy = {"offers": "l_orderkey", "payloads": "event_id"}.get(name) if position == 0 else None
        (df.repartition(heavy) if heavy else df).createOrReplaceTempView(source)
    return spark.sql(text)


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """SQL text with the named views (then ``extra`` ones) as leading CTEs."""
    parts = [f"{n} as ({VIEWS[n][0]})" for n in names]
    parts += [f"{n} as ({t})" for n, t in (extra or {}).items()]
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body
