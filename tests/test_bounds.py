"""History bounds, refits, keys a model leaves out, and publication that survives failures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from queuetide.operators.context import prepare_context
from queuetide.plans import backtest, forecast
from queuetide.session import shared_dir
from queuetide.sinks import snapshots

AS_OF = "2024-03-01 00:00:00"


def readings(make, keys="AB", days=10, end="2024-03-01 00:00:00", value=None):
    stop = dt.datetime.fromisoformat(end)
    slots = [stop - dt.timedelta(minutes=15 * i) for i in range(1, days * 96)]
    return make([(k, str(t), float(value if value is not None else t.hour)) for k in keys for t in slots])


def test_years_old_rows_do_not_change_a_forecast(make):
    now = readings(make)
    old = readings(make, days=8, end="2020-03-01 00:00:00", value=999)
    rows = [sorted(map(str, forecast.batch_forecast(df, AS_OF, forecast.seasonal_forecast).collect())) for df in (now, now.unionByName(old))]
    assert rows[0] == rows[1] and len(rows[0]) > 2


def test_a_key_with_old_rows_only_has_no_rows(spark, make):
    raw = readings(make, "A").unionByName(readings(make, "B", 8, "2020-03-01 00:00:00"))
    keys = spark.createDataFrame([("A",), ("B",)], "airport string")
    status = {r["airport"]: r["status"] for r in prepare_context(raw, AS_OF, keys=keys).stats.collect()}
    assert status == {"A": "ok", "B": "no_rows"}


def test_short_history_fails_where_rows_are_missing(make):
    with pytest.raises(Exception, match="history truncated"):
        prepare_context(readings(make), AS_OF, expected_rows=10**6)


def test_a_usable_key_without_predictions_gets_a_message(make):
    def one_key(context, future, levels):
        return forecast.naive_forecast(context, future, levels).where("airport = 'A'")

    rows = forecast.batch_forecast(readings(make), AS_OF, one_key).collect()
    other = [r for r in rows if r["airport"] == "B"]
    assert [(r["message"], r["mean"]) for r in other] == [("B: No predictions returned by model", None)]
    assert all(r["mean"] is not None and r["message"] is None for r in rows if r["airport"] == "A")


def test_backtest_ignores_rows_before_its_bound(make):
    setup = backtest.Setup(as_of=AS_OF, backtest_days=2, train_days=3, horizons_h=[1, 4], min_train_rows=10, spare_days=1)
    grid = readings(make).select("airport", F.col("timestamp").alias("slot"), "queue")
    old = readings(make, days=8, end="2023-03-01 00:00:00", value=999).select("airport", F.col("timestamp").alias("slot"), "queue")
    runs = [sorted(map(str, backtest.run_backtest(df, setup).collect())) for df in (grid, grid.unionByName(old))]
    assert runs[0] == runs[1]


def test_fits_are_made_at_origins():
    assert backtest.fit_numbers([900] * 9, 7, 24, 500) == [0, 0, 0, 0, 4, 4, 4, 4, 8]
    assert backtest.fit_numbers([10, 10, 600, 600], 6, 24, 500) == [None, None, 2, 2]
    assert backtest.fit_numbers([600, 600, 10, 600], 12, 24, 500) == [0, 0, None, 3]


def test_failing_retry_leaves_the_visible_run(spark, tmp_path):
    path, good = str(tmp_path / "runs"), spark.range(3)

    def failing():
        return spark.range(2).select(F.raise_error(F.lit("x" * 900)).alias("id"))

    assert snapshots.refresh(spark, path, 1, AS_OF, lambda: good) == "ok"
    error = snapshots.refresh(spark, path, 1, AS_OF, failing)
    assert error != "ok" and snapshots.last_good(spark, path).count() == 3
    long = snapshots.refresh(spark, path, 2, AS_OF, failing)
    assert "x" * 900 in long and snapshots.last_good(spark, path).count() == 3
    assert snapshots.refresh(spark, path, 2, AS_OF, lambda: spark.range(5)) == "ok"
    assert snapshots.last_good(spark, path).count() == 5


def test_last_good_checks_the_row_count(spark, tmp_path):
    path = str(tmp_path / "runs")
    snapshots.publish_forecast(spark.range(4), path, 1, AS_OF)
    folder = snapshots.manifest(spark, path).first()["folder"]
    spark.range(1).write.mode("append").parquet(f"{path}/{folder}")
    with pytest.raises(ValueError, match="rows of its manifest"):
        snapshots.last_good(spark, path)


def test_without_a_shared_folder_the_library_says_so(spark):
    class Context:
        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_stream_files_follow_time_over_two_months(spark, make):
    from queuetide.registry.streams import _finish
    from queuetide.streaming.replay import Replay, arrivals
    from queuetide.streaming.windows import stream_grid_average

    obs = readings(make, "A", days=60)
    replay = Replay(arrivals(obs, 8), 8, "months")
    out = _finish(replay, stream_grid_average(replay.stream()))
    edge = obs.agg(F.max("timestamp") - F.expr("INTERVAL '75' MINUTE")).first()[0]
    assert out.count() == obs.where(F.col("timestamp") <= F.lit(edge)).count() > 5000
