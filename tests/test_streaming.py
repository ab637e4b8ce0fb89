"""Streams run to the end of a few files and are compared with their batch form."""

import pytest
from pyspark.sql import functions as F

from queuetide.operators.grid import grid_average
from queuetide.registry import streams
from queuetide.streaming import alarm, windows
from queuetide.streaming.replay import Replay, arrivals, committed_batches


@pytest.fixture()
def run(spark, tmp_path):
    def go(batches, transform, mode="append"):
        source, sink = tmp_path / "in", tmp_path / "out"
        for df in batches:
            df.coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        q = (transform(stream).writeStream.format("parquet").option("path", str(sink)).outputMode(mode)
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
        q.awaitTermination()
        return spark.read.parquet(str(sink))

    return go


def stamps(day, minutes):
    return [f"2026-04-{day:02d} {m // 60:02d}:{m % 60:02d}:00" for m in minutes]


def test_silent_key_raises_exactly_one_alarm(run, make):
    first = make([(k, t, 1.0) for k in "AB" for t in stamps(1, range(0, 300, 5))])
    second = make([("A", t, 1.0) for t in stamps(1, range(300, 600, 5))])
    third = make([("A", t, 1.0) for t in stamps(1, range(600, 660, 5))])
    out = run([first, second, third], lambda s: alarm.stale_feed_alarm(s, 20)).collect()
    assert [(r["airport"], str(r["last_seen"])) for r in out] == [("B", "2026-04-01 04:55:00")]


def test_late_rows_count_up_to_the_watermark(run, make):
    # Lateness is judged by the watermark of the batch before last, so the late rows come third.
    first = make([("A", t, 2.0) for t in stamps(1, range(0, 115, 5))])
    second = make([("A", t, 2.0) for t in stamps(1, range(115, 120, 5))])
    late = make([("A", "2026-04-01 01:10:00", 8.0), ("A", "2026-04-01 00:10:00", 8.0)])
    last = make([("A", t, 2.0) for t in stamps(1, range(120, 300, 5))])
    out = run([first, second, late, last], lambda s: windows.stream_grid_average(s, 15, "1 hour"))
    got = {str(r["slot"])[11:16]: r["queue"] for r in out.collect()}
    assert got["01:00"] == pytest.approx((2 * 3 + 8) / 4)
    assert got["00:00"] == 2.0


def test_stream_equals_batch_below_the_watermark(run, make):
    parts = [make([(k, t, float(i % 9)) for k in "AB" for i, t in enumerate(stamps(d, range(0, 1440, 7)))]) for d in (1, 2, 3)]
    out = run(parts, lambda s: windows.stream_grid_average(s, 15, "1 hour"))
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    edge = whole.agg(F.max("timestamp") - F.expr("INTERVAL '75' MINUTE")).first()[0]
    batch = grid_average(whole, 15).where(F.col("slot") <= F.lit(edge))
    assert out.count() == batch.count()
    assert out.select("airport", "slot", F.round("queue", 9)).exceptAll(batch.select("airport", "slot", F.round("queue", 9))).count() == 0


def test_repeated_rows_are_dropped(run, make):
    rows = make([("A", t, 1.0) for t in stamps(1, range(0, 60, 5))])
    assert run([rows, rows], windows.stream_dedup).count() == 12


# --- batches, late rows, a restart -----------------------------------------------------

def test_arrivals_cut_the_time_in_equal_spans(make):
    rows = make([("A", t, 1.0) for t in stamps(1, range(0, 600, 5))])
    got = arrivals(rows, 6, behind=F.when(F.col("id") == 1, 2).otherwise(0)).groupBy("batch").count().orderBy("batch").collect()
    assert [(r["batch"], r["count"]) for r in got] == [(0, 19), (1, 20), (2, 21), (3, 20), (4, 20), (5, 20)]
    assert arrivals(rows.limit(0), 6).count() == 0


def replayed(spark, tmp_path, rows, transform, n=6, restart=3):
    replay, sink, state = Replay(rows, n), str(tmp_path / "sink"), str(tmp_path / "state")
    out = transform(replay)
    writer = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True)
    with streams._settings(spark):
        replay.run(writer.start, state, restart)
    return spark.read.schema(out.schema).parquet(sink), committed_batches(spark, state)


def test_late_rows_go_and_a_restart_doubles_none(spark, make, tmp_path):
    rows = make([(k, t, float(i)) for k in "AB" for i, t in enumerate(stamps(1, range(0, 1440, 5)))])
    late = F.when(F.col("id") == 10, 4).when(F.col("id") == 20, 1).otherwise(0)
    fed = arrivals(rows, 6, behind=late)
    twice = fed.unionByName(fed.withColumn("batch", F.least(F.lit(5), F.col("batch") + 1)))
    out, batches = replayed(spark, tmp_path, twice, lambda r: windows.stream_dedup(r.stream(), "30 minutes"))
    ids = [r["id"] for r in out.select("id").collect()]
    assert batches >= 6
    assert sorted(ids) == [i for i in range(1, 577) if i != 10]


def test_every_batch_is_a_micro_batch_of_its_own(spark, make, tmp_path):
    rows = arrivals(make([("A", t, 1.0) for t in stamps(1, range(0, 1440, 5))]), 6)
    out, batches = replayed(spark, tmp_path, rows, lambda r: windows.stream_grid_average(r.stream(), 15, "0 minutes"))
    assert batches >= 6 + 2  # two without data: before the restart and at the end
    assert out.count() == 95


def test_standing_alarm_speaks_for_the_unheard_and_the_silent(spark, make, tmp_path):
    heard = make([("A", t, 1.0) for t in stamps(1, range(0, 1440, 5))]
                 + [("B", t, 1.0) for t in stamps(1, [*range(0, 300, 5), *range(600, 900, 5)])]
                 + [("late", "2026-04-01 10:00:00", 1.0)])
    keys = spark.createDataFrame([(k, "2026-04-01 00:00:00") for k in ("A", "B", "never")], "airport string, since string").select(
        "airport", F.col("since").cast("timestamp_ntz").alias("since"))
    ticks = spark.createDataFrame([("2026-04-02 03:00:00", 5)], "timestamp string, batch int").select(
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "batch")

    def watch(replay):
        beside = Replay(ticks, 6)
        feed = replay.feed
        replay.feed = lambda until: (feed(until), beside.feed(until))
        return alarm.standing_alarm(replay.stream(), keys, 20, ticks=beside.stream())

    out, batches = replayed(spark, tmp_path, arrivals(heard, 6), watch)
    assert batches >= 6
    got = sorted((r["airport"], str(r["last_seen"]), str(r["alarm_at"])) for r in out.collect())
    assert got == [("A", "2026-04-01 23:55:00", "2026-04-02 00:15:00"), ("B", "2026-04-01 04:55:00", "2026-04-01 05:15:00"),
                   ("B", "2026-04-01 14:55:00", "2026-04-01 15:15:00"), ("late", "2026-04-01 10:00:00", "2026-04-01 10:20:00"),
                   ("never", "None", "2026-04-01 00:20:00")]
