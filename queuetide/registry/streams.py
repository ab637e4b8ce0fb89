"""Streaming forms, run to the end of the given tables and compared with batch SQL.

A table is fed in six batches cut by time, each a file. One row in 59 comes a batch late,
which the watermarks here still allow but after the restart, and one in 53 two batches
late, which they do not. After three batches the query ends, and a new one goes on from
its checkpoint. Sinks are tables in the shared folder.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ID, KEY, TS, VALUE
from ..session import scratch_path
from ..sinks.writers import batch_folders
from ..streaming import alarm, ingest as ingest_stream, windows
from ..streaming.replay import Replay, arrivals
from .catalog import query, rounded
from .reading import OUTCOMES
from .tables import view, with_views

BATCHES, RESTART = 6, 3


def _replay(df: DataFrame, label: str, by: str = TS, key: str = ID) -> Replay:
    behind = F.when(F.col(key) % 53 == 0, 2).when(F.col(key) % 59 == 0, 1).otherwise(0)
    return Replay(arrivals(df, BATCHES, by, behind), BATCHES, label)


def arrived(source: str, late: str, key: str = "id", late_copies: int = 0) -> dict[str, str]:
    """SQL for the view ``arrived``: rows with ``behind``, up to where the batch they come in no longer takes rows.

    Rows are judged by the watermark as it stood when the batch before began: by all
    batches but the last two, or but the last one right after the restart, when a batch
    without rows came in between.
    """
    return {
        "edges": f"select min(epoch_us(timestamp)) as lo, max(epoch_us(timestamp)) as hi from {source}",
        "stamped": f"""select s.*, least({BATCHES - 1}, {late_copies} + cast((epoch_us(timestamp) - lo) * {BATCHES} // (hi - lo + 1) as int)
            + case when {key} % 53 = 0 then 2 when {key} % 59 = 0 then 1 else 0 end) as batch from {source} s, edges""",
        "marks": f"""select n as batch, (select max(timestamp) from stamped t
              where t.batch <= n - case when n = {RESTART} then 1 else 2 end) - interval {late} as behind
            from (select unnest(range({BATCHES})) as n)""",
        "arrived": "select s.*, behind from stamped s join marks using (batch)",
    }


@contextmanager
def _settings(spark: SparkSession):
    """A stream keeps the number of state partitions it starts with, one per core here, and its kind of state store."""
    ours = {"spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism), alarm.STATE_STORE[0]: alarm.STATE_STORE[1]}
    before = {name: spark.conf.get(name) for name in ours}
    for name, value in ours.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _finish(replay: Replay, out: DataFrame, mode: str = "append") -> DataFrame:
    """Run to the end of the input, with a restart, and read the sink back."""
    spark, path = out.sparkSession, scratch_path(out.sparkSession, "sink")
    state = f"{path}-state"
    writer = (out.writeStream.format("parquet").option("path", path).option("checkpointLocation", state)
              .outputMode(mode).trigger(availableNow=True))
    with _settings(spark):
        replay.run(writer.start, state, RESTART)
    return spark.read.schema(out.schema).parquet(path)


@query("stream_grid_average", with_views("""
select airport, slot, round(avg(queue), 6) as queue
from (select *, time_bucket(interval '15 minutes', timestamp) as slot from arrived)
where behind is null or slot + interval 15 minute > behind
group by all having slot + interval 15 minute <= (select max(timestamp) - interval 1 hour from usable)
""", "obs", extra={"usable": "select * from obs where queue >= 0", **arrived("usable", "1 hour")}))
def grid(spark, sf):
    replay = _replay(view(spark, sf, "obs").where(F.col(VALUE) >= 0), "usable")
    return rounded(_finish(replay, windows.stream_grid_average(replay.stream())), VALUE)


@query("stream_pull_health", with_views("""
select airport, edge as "at", count(*) filter (status in ('success', 'skipped')) as successes,
  count(*) filter (status = 'failure') as failures, round(count(*) filter (status in ('success', 'skipped')) / count(*), 6) as success_rate
from (select *, unnest([time_bucket(interval '5 minutes', timestamp) + interval 5 minute,
                        time_bucket(interval '5 minutes', timestamp) + interval 10 minute]) as edge from arrived)
where (behind is null or edge > behind) and edge <= (select max(timestamp) - interval 1 hour from pulls) group by all""",
                                        "pulls", extra=arrived("pulls", "1 hour", "pull_id")))
def pulls(spark, sf):
    replay = _replay(view(spark, sf, "pulls"), "pulls", key="pull_id")
    return rounded(_finish(replay, windows.stream_pull_health(replay.stream())), "success_rate")


# Every reading is sent twice, the second time a batch later. Both are judged by when they come.
@query("stream_dedup", with_views("""
select id, timestamp, airport, queue from arrived where behind is null or timestamp > behind
union
select id, timestamp, airport, queue from again where behind is null or timestamp > behind""", "obs", extra={
    **arrived("obs", "1 hour"), "stamped_again": arrived("obs", "1 hour", late_copies=1)["stamped"],
    "again": "select s.*, behind from stamped_again s join marks using (batch)"}))
def dedup(spark, sf):
    obs = view(spark, sf, "obs")
    behind = F.when(F.col(ID) % 53 == 0, 2).when(F.col(ID) % 59 == 0, 1).otherwise(0)
    once = arrivals(obs, BATCHES, TS, behind)
    twice = once.unionByName(once.withColumn("batch", F.least(F.lit(BATCHES - 1), F.col("batch") + 1)))
    replay = Replay(twice, BATCHES, "twice")
    return _finish(replay, windows.stream_dedup(replay.stream())).select(ID, TS, KEY, VALUE)


@query("stream_gauges", with_views("""
select airport, arg_max(queue, id) as queue, max(timestamp) as last_at from obs group by airport""", "obs"))
def gauges(spark, sf):
    """Each batch's changed rows are upserted; what is left is the newest row per key."""
    path = scratch_path(spark, "gauges")
    replay = _replay(view(spark, sf, "obs"), "obs")
    store = batch_folders(path)
    writer = (windows.stream_gauges(replay.stream()).writeStream.outputMode("update").trigger(availableNow=True)
              .option("checkpointLocation", f"{path}-state").foreachBatch(store))
    with _settings(spark):
        replay.run(writer.start, f"{path}-state", RESTART)
    newest = spark.read.parquet(path).groupBy(KEY)
    return newest.agg(F.max_by(VALUE, "batch").alias(VALUE), F.max_by("last_at", "batch").alias("last_at"))


@query("stream_ingest", with_views(
    "select payload_id, airport, timestamp, queue from outcomes where status = 'success'", "payloads",
    extra={"outcomes": OUTCOMES}))
def ingest(spark, sf):
    root = scratch_path(spark, "ingest")
    replay = _replay(view(spark, sf, "payloads"), "payloads", "fetched_at", "payload_id")

    def start():
        return ingest_stream.ingest(replay.stream(), f"{root}-state", {
            "table": batch_folders(f"{root}/table"), "mirror": batch_folders(f"{root}/mirror")}, f"{root}/status")

    replay.run(start, f"{root}-state", RESTART)
    return spark.read.parquet(f"{root}/table").drop("batch")


@query("stream_stale_feed_alarm", with_views("""
select airport, timestamp as last_seen, timestamp + interval 60 minute as alarm_at
from (select airport, timestamp, lead(timestamp) over (partition by airport order by timestamp) as following
      from arrived where behind is null or timestamp + interval 60 minute > behind)
where coalesce(following > timestamp + interval 60 minute, (select max(timestamp) from obs) >= timestamp + interval 60 minute)""",
                                             "obs", extra=arrived("obs", "0 hour")))
def stale(spark, sf):
    """Silences of more than an hour raise an alarm."""
    replay = _replay(view(spark, sf, "obs"), "silent")
    return _finish(replay, alarm.stale_feed_alarm(replay.stream(), 60))


# 'view' is silent for the last days, 'nowhere' always; a last tick comes two hours after the last reading.
WATCHED = {
    "heard": "select id, airport, timestamp from obs where not (airport = 'view' and timestamp > (select max(timestamp) - interval 3 day from obs))",
    **arrived("heard", "0 hour"),
    "watched": "select distinct airport, (select min(timestamp) - interval 90 minute from heard) as since from obs union all select 'nowhere', (select min(timestamp) - interval 90 minute from heard)",
    "kept": """select airport, timestamp, true as seen from arrived where behind is null or timestamp > behind
        union all select airport, since, false from watched""",
}


@query("stream_standing_alarm", with_views("""
select airport, case when seen then timestamp end as last_seen, timestamp + interval 60 minute as alarm_at
from (select airport, timestamp, seen, lead(timestamp) over (partition by airport order by timestamp) as following from kept)
where coalesce(following > timestamp + interval 60 minute, true)""", "obs", extra=WATCHED))
def standing(spark, sf):
    """Silences, a key never heard of, and keys silent at the end each raise one alarm."""
    obs = view(spark, sf, "obs").select(ID, KEY, TS)
    first, last = obs.agg(F.min(TS), F.max(TS)).first()
    heard = obs.where(~((F.col(KEY) == "view") & (F.col(TS) > F.lit(last) - F.expr("INTERVAL '3' DAY"))))
    first = heard.agg(F.min(TS)).first()[0]
    since = F.lit(first) - F.expr("INTERVAL '90' MINUTE")
    keys = (obs.select(KEY).distinct().unionByName(spark.range(1).select(F.lit("nowhere").alias(KEY))).withColumn("since", since))
    replay = _replay(heard, "heard")
    end = spark.range(1).select((F.lit(last) + F.expr("INTERVAL '2' HOUR")).alias(TS), F.lit(BATCHES - 1).alias("batch"))
    ticks = Replay(end, BATCHES, "ticks")
    out = alarm.standing_alarm(replay.stream(), keys, 60, ticks=ticks.stream())
    return _together(replay, ticks, out)


def _together(replay: Replay, ticks: Replay, out: DataFrame) -> DataFrame:
    """As :func:`_finish`, with ticks fed beside the readings."""
    feed = replay.feed

    def both(until: int) -> None:
        feed(until)
        ticks.feed(until)

    replay.feed = both
    return _finish(replay, out)
