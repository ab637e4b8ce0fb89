"""Grids, profiles, as-of lookups, gap bridging and the forecaster's context."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from queuetide.operators import asof, context, grid as grids, latest
from queuetide.operators.profiles import build_profiles, profile_lookup
from queuetide.sources.observations import assert_complete, clean_obs
from queuetide.sources.offers import report_lines

START = datetime(2026, 4, 1)


def ts(minutes):
    return str(START + timedelta(minutes=minutes))


def diurnal(i, step=15):
    minute = (i * step) % 1440
    return 12 + 9 * math.sin(2 * math.pi * minute / 1440)


def test_clean_and_grid(make):
    obs = make([("A", ts(0), 4.0), ("A", ts(4), 8.0), ("A", ts(7), -1.0), ("A", ts(8), float("nan")), ("A", ts(9), 1e10),
                ("A", None, 3.0), ("A", ts(11), None)])
    kept = grids.grid_average(clean_obs(obs, drop_negative=True), 5).collect()
    assert [(r["slot"], r["queue"]) for r in kept] == [(START, 6.0)]
    assert clean_obs(obs).count() == 3


def test_truncated_history_fails_and_unknown_total_passes(make):
    obs = make([("A", ts(0), 1.0), ("A", ts(5), 1.0)])
    assert assert_complete(obs, None).count() == 2
    assert assert_complete(obs, 2).count() == 2
    with pytest.raises(Exception, match="received 2 of 3 rows"):
        assert_complete(obs, 3).collect()


def test_profile_falls_back_from_slot_to_time_to_mean_to_zero(make, spark):
    history = grids.grid_average(make([("A", "2026-06-01 00:00", 9.0), ("A", "2026-06-02 06:00", 3.0)]), 5)
    asked = make([("A", "2026-06-08 00:00", None), ("A", "2026-06-09 00:00", None), ("A", "2026-06-09 13:00", None), ("B", "2026-06-09 13:00", None)])
    out = profile_lookup(asked.withColumnRenamed("timestamp", "slot"), build_profiles(history, "UTC", 5))
    assert [(r["profile_dow_time"], r["profile_time"]) for r in out.orderBy("id").collect()] == [
        (9.0, 9.0), (9.0, 9.0), (6.0, 6.0), (0.0, 0.0)]


def brute_nearest(samples, moment, tol):
    best = [(abs((t - moment).total_seconds()), -t.timestamp(), v) for t, v in samples]
    best = [b for b in best if b[0] <= tol * 60]
    return min(best)[2] if best else None


@pytest.mark.parametrize("tol", [5, 90, 4000])
def test_nearest_matches_brute_force(make, spark, tol):
    rnd = random.Random(tol)
    samples = {k: sorted({START + timedelta(minutes=rnd.randrange(20000)) for _ in range(60)}) for k in "AB"}
    rows = [(k, str(t), float(i)) for k, ts_ in samples.items() for i, t in enumerate(ts_)]
    asked = [(k, str(START + timedelta(minutes=rnd.randrange(-500, 21000))), None) for k in "ABC" for _ in range(150)]
    out = asof.asof_nearest(make(asked).drop("queue"), make(rows), ["queue"], within_min=tol)
    for r in out.collect():
        pairs = [(t, float(i)) for i, t in enumerate(samples.get(r["airport"], []))]
        assert r["queue"] == brute_nearest(pairs, r["timestamp"], tol)


def test_tie_takes_the_later_sample_and_tolerance_is_inclusive(make):
    samples = make([("A", ts(0), 1.0), ("A", ts(10), 2.0)])
    asked = make([("A", ts(5), None), ("A", ts(15), None), ("A", ts(16), None)]).drop("queue")
    out = asof.asof_nearest(asked, samples, ["queue"], within_min=5).orderBy("timestamp")
    assert [r["queue"] for r in out.collect()] == [2.0, 2.0, None]


def test_backward_carries_across_many_empty_days(make):
    samples = make([("A", ts(0), 1.0), ("A", ts(3), 2.0), ("B", ts(5000), 7.0)])
    asked = make([("A", ts(100000), None), ("A", ts(1), None), ("A", ts(-1), None), ("B", ts(4999), None), ("B", ts(5000), None)]).drop("queue")
    out = asof.asof_backward(asked, samples, ["queue"]).orderBy("id")
    assert [r["queue"] for r in out.collect()] == [2.0, 1.0, None, None, 7.0]


def test_match_takes_the_first_point_in_reach_not_the_nearest(make):
    points = make([("A", ts(0), 1.0), ("A", ts(15), 2.0), ("A", ts(30), 3.0)])
    asked = make([("A", ts(15), None), ("A", ts(46), None), ("A", ts(-15), None)]).drop("queue")
    out = asof.match_within(asked, points, ["queue"]).orderBy("id")
    assert [r["queue"] for r in out.collect()] == [1.0, None, 1.0]


def test_forward_fill_repeats_and_drops_the_empty_first_bin(make):
    out = grids.resample_ffill(make([("A", ts(2), 1.0), ("A", ts(4), 2.0), ("A", ts(14), 3.0), ("A", ts(16), 4.0)]), 5)
    assert [(r["timestamp"], r["queue"]) for r in out.orderBy("timestamp").collect()] == [
        (START + timedelta(minutes=5), 2.0), (START + timedelta(minutes=10), 2.0), (START + timedelta(minutes=15), 3.0)]


def test_top_rows_by_id_not_by_time(make):
    obs = make([("A", ts(50), 1.0), ("A", ts(10), 2.0), ("A", ts(20), 3.0), ("B", ts(5), 9.0)])
    assert {r["airport"]: r["queue"] for r in latest.latest_per_key(obs).collect()} == {"A": 3.0, "B": 9.0}
    assert sorted(r["queue"] for r in latest.last_n_per_key(obs, 2).collect()) == [2.0, 3.0, 9.0]


def test_numbers_are_consecutive_in_order(spark):
    df = spark.range(0, 5000, numPartitions=7).select(((F.col("id") * 7919) % 5000).alias("x"))
    out = latest.number_rows(df, "x")
    assert out.where(F.col("number") != F.col("x") + 1).count() == 0
    assert out.select("total").distinct().collect()[0][0] == 5000


def test_numbering_makes_its_input_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    out = latest.number_rows(spark.range(0, 3000, numPartitions=5).mapInArrow(counted, "id long"), "id")
    assert out.where(F.col("number") != F.col("id") + 1).count() == 0
    assert made.value == 3000


def test_a_report_line_writes_what_is_missing_as_null(spark):
    row = spark.createDataFrame([(7, 100, "CPH", None, "12.50", "DKK", "2026-01-01T10:05:00Z"), (8, 100, "CPH", "OSL", None, None, "late")],
                                "number long, total long, origin string, destination string, price string, currency string, time_iso string")
    assert [r["line"] for r in report_lines(row).orderBy("number").collect()] == [
        "007. CPH : null - 12.50 DKK - 10:05", "008. CPH : OSL - null null - null"]


def test_month_back_clamps(make):
    obs = make([("A", "2024-02-28 12:00", 1.0), ("A", "2024-03-01 12:00", 2.0), ("A", "2024-03-30 12:00", 3.0)])
    row = latest.historical_comparison(obs, "2024-03-31 12:00").first()
    assert (row["yesterday"], row["month"], row["year"]) == (3.0, 1.0, None)


# --- gaps and context ----------------------------------------------------------

def series(make, values, key="A"):
    return make([(key, ts(15 * i), v) for i, v in enumerate(values) if v is not None])


def prepare(make, values, as_of=None, **options):
    as_of = as_of or ts(15 * (len(values) - 1))
    return context.prepare_context(series(make, values), as_of, **options)


def test_night_long_gap_is_bridged_closer_than_a_straight_line(make):
    truth = [diurnal(i) for i in range(960)]
    holed = [None if 700 <= i < 748 else v for i, v in enumerate(truth)]
    got = {r["slot"]: r["queue"] for r in prepare(make, holed).context.collect()}
    assert len(got) == 960
    mine, line = 0.0, 0.0
    for i in range(700, 748):
        mine += (got[START + timedelta(minutes=15 * i)] - truth[i]) ** 2
        straight = truth[699] + (truth[748] - truth[699]) * (i - 699) / 49
        line += (straight - truth[i]) ** 2
    assert math.sqrt(mine) < 0.5 * math.sqrt(line)


def test_gap_beyond_the_limit_splits_and_the_recent_part_is_taken(make):
    values = [None if 600 <= i < 674 else diurnal(i) for i in range(800)]
    p = prepare(make, values)
    s = p.stats.first()
    assert s["status"] == "ok" and s["context_rows"] == 126 and s["rows_missing_after_fill"] == 74
    assert s["selected_segment_start"] == START + timedelta(minutes=15 * 674)
    assert p.context.agg(F.min("slot")).first()[0] == s["selected_segment_start"]


def test_edges_are_never_filled_and_fill_is_never_negative(make):
    values = [None] * 5 + [diurnal(i) for i in range(100)] + [0.0] + [None] * 20 + [0.0] + [1.0] * 10 + [None] * 5
    obs = grids.grid_average(series(make, values), 15)
    out = context.seasonal_fill(obs, build_profiles(obs, None, 1))
    first, last, low = out.agg(F.min("slot"), F.max("slot"), F.min("queue")).first()
    assert first == START + timedelta(minutes=75) and last == START + timedelta(minutes=15 * 136)
    assert low >= 0 and out.where("filled").count() == 20


def test_sentinel_is_missing_and_then_bridged(make):
    values = [diurnal(i) for i in range(200)]
    values[100] = -1.0
    s = prepare(make, values).stats.first()
    assert (s["negative_sentinel_rows"], s["rows_seasonally_filled"], s["valid_rows"]) == (1, 1, 199)
    assert s["context_synthetic_ratio"] == pytest.approx(1 / 200)


@pytest.mark.parametrize("values, as_of, status", [
    ([diurnal(i) for i in range(200)], ts(15 * 199 + 360), "ok"),
    ([diurnal(i) for i in range(200)], ts(15 * 199 + 361), "stale_history"),
    ([diurnal(i) for i in range(63)], None, "insufficient_history"),
    ([-1.0] * 80, None, "no_valid_rows")])
def test_refusals(make, values, as_of, status):
    p = prepare(make, values, as_of)
    assert p.stats.first()["status"] == status
    assert (p.context.count() > 0) == (status == "ok")


def test_future_is_eight_hours_from_the_context_end(make):
    p = prepare(make, [diurnal(i) for i in range(200)])
    first, last, n = context.future_grid(p).agg(F.min("slot"), F.max("slot"), F.count("slot")).first()
    end = START + timedelta(minutes=15 * 199)
    assert (first - end, last - end, n) == (timedelta(minutes=15), timedelta(hours=8), 32)
