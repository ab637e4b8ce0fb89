from datetime import datetime

import pytest
from pyspark.sql import functions as F

from queuetide.functions import calendar as cal
from queuetide.functions import numbers as num
from queuetide.operators.latest import holiday_flag


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("utc, hour", [("2026-01-15 12:00", 13), ("2026-07-15 12:00", 14),
                                       ("2026-03-29 00:30", 1), ("2026-03-29 01:30", 3), ("2026-10-25 01:30", 2)])
def test_local_hour_follows_daylight_saving(spark, utc, hour):
    assert value(spark, F.hour(cal.to_local(cal.as_ts(utc)))) == hour


def test_features_have_fixed_ranges(spark):
    df = spark.range(288).select((cal.as_ts("2026-03-14") + F.col("id") * F.expr("INTERVAL '5' MINUTE")).alias("timestamp"))
    row = cal.time_covariates(df).agg(*[F.max(F.abs(F.col(f"{w}_sin") ** 2 + F.col(f"{w}_cos") ** 2 - 1)).alias(w)
                                        for w in ("tod", "tow", "doy")], F.min("is_weekend").alias("weekend"),
                                      F.max("minute").alias("m")).first()
    assert max(row["tod"], row["tow"], row["doy"]) < 1e-9
    assert row["weekend"] == 1.0 and row["m"] == 55.0


def test_time_of_day_wave_uses_the_raw_minute(spark):
    df = spark.createDataFrame([("2026-01-15 12:03",)], "timestamp string").select(F.col("timestamp").cast("timestamp_ntz"))
    row = cal.cyclical_features(cal.calendar_features(df, tz="UTC"), tz="UTC").first()
    import math
    assert row["minute"] == 0
    assert row["tod_sin"] == pytest.approx(math.sin(2 * math.pi * 723 / 1440))


def test_holiday(spark):
    days = spark.createDataFrame([("CPH", "2026-01-01")], "airport string, date string").select(
        "airport", F.col("date").cast("date"))
    asked = spark.createDataFrame([("CPH", "2026-01-01"), ("CPH", "2026-03-17"), ("ARN", "2026-01-01")],
                                  "airport string, date string").select("airport", F.col("date").cast("date"))
    got = {(r["airport"], str(r["date"])): r["holiday"] for r in holiday_flag(asked, days).collect()}
    assert got == {("CPH", "2026-01-01"): 1, ("CPH", "2026-03-17"): 0, ("ARN", "2026-01-01"): 0}


@pytest.mark.parametrize("text, want", [
    ("2026-08-14T09:30:00", datetime(2026, 8, 14, 9, 30)), ("2026-08-14T09:30:00Z", datetime(2026, 8, 14, 9, 30)),
    ("2026-08-14T09:30:00+02:00", datetime(2026, 8, 14, 7, 30)), ("2026-08-14T09:30:00-0130", datetime(2026, 8, 14, 11, 0)),
    ("nonsense", None)])
def test_zone_suffix_is_honoured_and_none_means_utc(spark, text, want):
    assert value(spark, cal.parse_utc(F.lit(text))) == want


def test_rounding_rules(spark):
    assert [value(spark, num.round_even(F.lit(x))) for x in (0.5, 1.5, 2.5)] == [0.0, 2.0, 2.0]
    assert [value(spark, num.round_up_half(F.lit(x))) for x in (0.5, -0.5, 2.5)] == [1, 0, 3]


def test_quantile_keys_do_not_collide():
    assert [num.quantile_key(q) for q in (0.01, 0.05, 0.1, 0.15, 0.5, 0.9)] == ["0.01", "0.05", "0.1", "0.15", "0.5", "0.9"]
    assert [num.quantile_name(q) for q in (0.1, 0.5, 0.9)] == ["q10", "q50", "q90"]
    assert [num.quantile_name(q) for q in (0.02, 0.025, 0.975, 0.98, 0.005)] == ["q2", "q2_5", "q97_5", "q98", "q0_5"]


def test_bands_never_cross_and_never_go_below_zero(spark):
    cols = num.non_crossing([F.lit(5.0), F.lit(-3.0), F.lit(4.0)])
    assert [value(spark, c) for c in cols] == [0.0, 4.0, 5.0]


def test_missing_quantiles_are_left_out_of_the_map(spark):
    got = value(spark, num.quantile_map({0.3: F.lit(1.0), 0.5: F.lit(None).cast("double"), 0.05: F.lit(0.2)}))
    assert got == {"0.3": 1.0, "0.05": 0.2, "q30": 1.0}


@pytest.mark.parametrize("change, arrow", [(0.6, "up"), (0.5, "flat"), (-0.6, "down")])
def test_trend(spark, change, arrow):
    assert value(spark, num.trend_arrow(F.lit(change))) == arrow


def test_remaining_horizon(spark):
    end = cal.as_ts("2026-01-01 10:00:30")
    assert value(spark, cal.minutes_remaining(end, "2026-01-01 10:02:00")) == -1
    assert value(spark, cal.hours_remaining(end, "2026-01-01 10:00:00")) == 1
    assert value(spark, cal.hours_remaining(cal.as_ts("2026-01-01 12:30"), "2026-01-01 10:00")) == 3
