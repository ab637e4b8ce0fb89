"""Scores, predictors, forecasts, live values, offers and sinks."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from queuetide.operators import health, live, scoring
from queuetide.operators.dedup import dedup_offers
from queuetide.operators.grid import grid_average
from queuetide.operators.profiles import profiles_asof
from queuetide.operators.context import future_grid, prepare_context
from queuetide.plans import backtest, forecast, models, origins
from queuetide.plans.serving import predict_response, validate_requests
from queuetide.sinks import snapshots, writers

START = datetime(2026, 4, 1)


def ts(minutes):
    return str(START + timedelta(minutes=minutes))


@pytest.fixture(scope="module")
def sine(make, spark):
    rnd = random.Random(1)
    rows = [(k, ts(5 * i), max(0.0, base + 3 * math.sin(i / 40) + rnd.gauss(0, 0.5)))
            for k, base in (("CPH", 6), ("ARN", 9)) for i in range(4000)]
    return grid_average(make(rows), 5).cache()


def test_scores(spark):
    df = spark.createDataFrame([("m", 1, 10.0, 8.0), ("m", 1, 10.0, 6.0)], "model string, horizon_h int, y double, mean double")
    for q in ("q10", "q50", "q90"):
        df = df.withColumn(q, F.lit(None).cast("double"))
    rows = {r["horizon"]: r for r in scoring.summarise_backtest(scoring.score_predictions(df)).collect()}
    assert set(rows) == {"1", "ALL"}
    assert rows["ALL"]["mae"] == 3.0 and rows["ALL"]["rmse"] == pytest.approx(math.sqrt(10)) and rows["ALL"]["wql"] is None


def test_pinball_is_asymmetric(spark):
    from queuetide.functions.numbers import pinball
    row = spark.range(1).select(pinball(F.lit(10.0), F.lit(8.0), 0.9).alias("a"), pinball(F.lit(8.0), F.lit(10.0), 0.9).alias("b")).first()
    assert row["a"] == pytest.approx(1.8) and row["b"] == pytest.approx(0.2)


def test_quantiles_are_ordered_and_non_negative(sine, spark):
    asked = sine.select("airport", (F.col("slot") + F.expr("INTERVAL '14' DAY")).alias("timestamp"))
    asked = asked.unionByName(spark.createDataFrame([("ZZZ",)], "airport string").withColumn("timestamp", F.lit(ts(0)).cast("timestamp_ntz")))
    out = models.quantile_profile_model(sine).predict(asked)
    assert out.where("q10 > q50 or q50 > q90 or q10 < 0").count() == 0
    assert out.where("airport = 'ZZZ'").select("q10", "q50", "q90").first() == (0.0, 0.0, 0.0)
    assert out.count() == 8001


def test_models_survive_a_round_trip(sine, spark, tmp_path):
    asked = sine.where("airport = 'CPH'").select("airport", F.col("slot").alias("timestamp"))
    model = models.quantile_profile_model(sine)
    model.save(str(tmp_path / "quantiles"))
    again = models.QuantileProfiles.load(spark, str(tmp_path / "quantiles"))
    assert again.predict(asked).exceptAll(model.predict(asked)).count() == 0


def test_profiles_at_an_origin_ignore_what_comes_later(sine, spark):
    frame = spark.createDataFrame([("CPH", ts(1440 * 3), ts(1440 * 3 + 60)), ("CPH", ts(1440 * 4), ts(1440 * 4 + 60))],
                                  "airport string, origin string, target string").select(
        "airport", F.col("origin").cast("timestamp_ntz"), F.col("target").cast("timestamp_ntz"))
    first = F.lit(ts(1440 * 3)).cast("timestamp_ntz")
    changed = sine.withColumn("queue", F.when(F.col("slot") > first, 1000.0).otherwise(F.col("queue")))
    a, b = (profiles_asof(h, frame, first, 24, None, 5).orderBy("origin").collect() for h in (sine, changed))
    assert a[0]["profile_dow_time"] == b[0]["profile_dow_time"]
    assert b[1]["profile_dow_time"] > a[1]["profile_dow_time"]


def test_backtest_is_the_same_for_any_partitioning(sine, spark):
    setup = backtest.Setup(as_of=ts(5 * 3999), backtest_days=5, origin_every_hours=12, horizons_h=[1, 24], train_days=6)
    runs = []
    for n in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out = backtest.run_backtest(sine, setup).orderBy("model", "horizon").collect()
        runs.append([(r["model"], r["horizon"], r["n"], round(r["mae"], 9)) for r in out])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert runs[0] == runs[1]
    assert {r[0] for r in runs[0]} == {"last_value", "seasonal_naive", "calendar"}
    assert {r[2] for r in runs[0] if r[1] == "24"} == {22}


def test_calendar_predictor_needs_enough_rows(sine):
    setup = backtest.Setup(as_of=ts(5 * 3999), backtest_days=2, horizons_h=[1], min_train_rows=100000)
    frame = backtest.backtest_frame(sine, setup)
    assert backtest.calendar_quantiles(sine, frame, setup).count() == 0


def test_boosted_model_has_ordered_bands(sine, spark, tmp_path):
    days = spark.createDataFrame([], "airport string, date date")
    fitted = models.gbt_calendar_model(sine, days, rounds=3, depth=3)
    out = fitted.predict(sine.select("airport", F.col("slot").alias("timestamp")))
    assert out.where("q10 > q50 or q50 > q90 or q10 < 0").count() == 0
    assert fitted.metrics.first()["mae"] < 5
    fitted.save(str(tmp_path / "trees"))
    again = models.BoostedCalendar.load(spark, str(tmp_path / "trees"))
    asked = sine.select("airport", F.col("slot").alias("timestamp"))
    assert again.predict(asked).exceptAll(fitted.predict(asked)).count() == 0


def test_contexts_at_origins_are_those_prepared_at_each(make, spark):
    """Gaps, an origin inside a slot, a stale key, a short one: each context equals the one prepared from what was known."""
    rnd = random.Random(4)
    known = [(k, 5 * i) for k, i in ((k, i) for k in ("A", "B") for i in range(1500)) if rnd.random() < 0.7 and not (
        k == "A" and 700 <= i < 740) and not (k == "B" and 900 <= i < 1000)]
    known += [("C", 5 * i) for i in range(0, 60)] + [("D", 7400 + 5 * i) for i in range(10)]
    grid = make([(k, ts(m), float(rnd.randrange(50))) for k, m in known]).select("airport", F.col("timestamp").alias("slot"), "queue").cache()
    setup = backtest.Setup(as_of=ts(7480), backtest_days=2, origin_every_hours=7, horizons_h=[1, 2])
    frame = backtest.backtest_frame(grid, setup).cache()
    rules = {"days": 3, "max_gap": 16, "min_rows": 20}
    made = origins.contexts_at_origins(grid, frame, setup, **rules)
    names = ["slot", "queue", "filled", "queue_lag_30d", "queue_avg_dow_time", "queue_avg_time", "tod_sin"]

    def plain(df, *columns):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())

    series = {r["series"]: (r["airport"], r["origin"]) for r in frame.select("airport", "origin").distinct().withColumn(
        "series", origins.series_name()).collect()}
    context, future = origins.context_rows(made, max_gap=16).cache(), origins.future_rows(made).cache()
    compared = 0
    for origin in sorted({o for _, o in series.values()})[::4]:
        upto = grid.where(F.col("slot") <= F.lit(str(origin)).cast("timestamp_ntz")).withColumnRenamed("slot", "timestamp")
        one = prepare_context(upto, str(origin), **rules)
        named = F.concat_ws(" @ ", "airport", F.lit(origin.strftime("%Y-%m-%dT%H:%M:%S.%f")))
        here = F.col("airport").endswith(origin.strftime(" @ %Y-%m-%dT%H:%M:%S.%f"))
        want = plain(one.context.withColumn("airport", named), "airport", *names)
        assert plain(context.where(here), "airport", *names) == want
        ahead = ["airport", "slot", "queue_lag_30d", "queue_avg_dow_time", "queue_avg_time"]
        assert plain(future.where(here), *ahead) == plain(future_grid(one).withColumn("airport", named), *ahead)
        compared += len(want)
    assert compared > 500


def test_a_forecast_model_predicts_within_its_horizon(sine):
    setup = backtest.Setup(as_of=sine.agg(F.max("slot")).scalar(), backtest_days=2, horizons_h=[1, 8, 24], train_days=5)
    frame = backtest.backtest_frame(sine, setup)
    out = origins.model_as_predictor(forecast.naive_forecast)(sine, frame, setup)
    last = backtest.last_at_origin(sine, frame, setup)
    assert out.count() == frame.count() and set(frame.columns) < set(out.columns)
    got = {r["horizon_h"]: r["n"] for r in out.groupBy("horizon_h").agg(F.count("mean").alias("n")).collect()}
    assert got[1] > 0 and got[24] == 0
    # The carried value is the mean of the readings of the origin's own slot.
    near = out.where("horizon_h = 1 and mean is not null").join(last, ["airport", "origin"])
    assert near.where("abs(mean - last_value) > 3").count() == 0
    assert out.where("mean is not null and (q10 <> mean or q90 <> mean)").count() == 0


def test_calendar_quantiles_equal_a_scan_of_each_fit(sine):
    setup = backtest.Setup(as_of=sine.agg(F.max("slot")).scalar(), backtest_days=3, origin_every_hours=7, horizons_h=[1, 24], train_days=4)
    setup = setup.resolved(sine.sparkSession)
    frame = backtest.backtest_frame(sine, setup)
    rows = [(r["airport"], r["slot"], r["queue"]) for r in sine.collect()]
    local = timedelta(hours=2)  # Copenhagen in April
    got = backtest.calendar_quantiles(sine, frame, setup).collect()
    first = min(r["origin"] for r in frame.collect())
    assert got
    for r in got[::7]:
        fit = first + timedelta(hours=28) * ((r["origin"] - first) // timedelta(hours=28))
        seen = [(s, q) for a, s, q in rows if a == r["airport"] and fit - timedelta(days=4) <= s <= fit]
        at = r["target"] + local
        same = [q for s, q in seen if ((s + local).weekday(), (s + local).hour, (s + local).minute) == (at.weekday(), at.hour, at.minute)]
        same = same or [q for s, q in seen if ((s + local).hour, (s + local).minute) == (at.hour, at.minute)] or [q for _, q in seen]
        values, place = sorted(same), 0.5 * (len(same) - 1)
        low, high = values[math.floor(place)], values[math.ceil(place)]
        assert r["q50"] == pytest.approx(low + (high - low) * (place - math.floor(place)))


def test_forecast_rows_and_placeholders(make):
    rows = [("CPH", ts(15 * i), 5.0 + i % 7) for i in range(100)] + [("ARN", ts(15 * i), 1.0) for i in range(96, 100)]
    out = {k: [r for r in forecast.batch_forecast(make(rows), ts(15 * 99)).collect() if r["airport"] == k] for k in ("CPH", "ARN")}
    assert len(out["CPH"]) == 32 and {r["mean"] for r in out["CPH"]} == {5.0 + 99 % 7}
    assert set(out["CPH"][0]["quantiles"]) >= {"0.05", "0.1", "0.5", "q30", "q70"} and len(out["CPH"][0]["quantiles"]) == 23
    assert [(r["mean"], r["message"]) for r in out["ARN"]] == [(None, "ARN: Not enough history after preprocessing: 4 rows")]


def test_requests(spark):
    rows = [("CPH", "2026-03-17T10:00"), ("cph", "2026-03-17T10:00"), (None, "2026-03-17T10:00"), ("CPH", None), (None, None),
            ("ZZZ", "2026-03-17T10:00"), ("CPH", "not-a-date"), ("", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "request_id int, airport string, timestamp string")
    out = validate_requests(df).orderBy("request_id").collect()
    assert [r["status"] for r in out] == [200, 200] + [400] * 6
    assert out[1]["airport"] == "CPH" and "Missing \"airport\" and" in out[4]["error"] and '"ZZZ"' in out[5]["error"]
    answer = predict_response(models.constant_model(validate_requests(df).where("status = 200"), 2.5)).first()
    assert answer["predicted_queue_length_minutes"] == 2 and answer["answered_for"] == "2026-03-17T10:00:00Z"


@pytest.mark.parametrize("minutes, usable", [(31, True), (30, True), (29, False), (-5, False)])
def test_freshness(make, spark, minutes, usable):
    rows = make([("CPH", ts(minutes), 5.0), ("CPH", ts(0), 4.0)]).withColumnRenamed("queue", "mean")
    stats = spark.createDataFrame([("CPH", "ok", 3, 0.1), ("EDI", "stale_history", 900, 0.0)],
                                  "airport string, status string, context_age_minutes int, context_synthetic_ratio double")
    fresh = health.forecast_freshness(rows, stats, ts(0))
    got = {r["airport"]: r for r in fresh.collect()}
    assert got["CPH"]["usable"] == usable and got["EDI"]["has_forecast"] is False
    assert health.service_health(fresh, rows).first()["status"] == ("ok" if usable else "stale")


def test_effective_value(make, spark):
    obs = make([("A", ts(0), 1.0), ("B", ts(0), 2.0), ("C", ts(0), 3.0), ("D", ts(-60), 4.0)])
    guess = spark.createDataFrame([("B", 7.5)], "airport string, predicted double")
    points = make([("C", ts(40), 9.4), ("C", ts(30), 8.5)]).withColumnRenamed("queue", "mean")
    stale = {r["airport"]: (r["effective"], r["origin"]) for r in live.effective_queue(obs, guess, points, ts(21)).collect()}
    assert stale == {"A": (1.0, "last_known"), "B": (8.0, "predicted"), "C": (9.0, "forecast"), "D": (4.0, "last_known")}
    fresh = {r["airport"]: r["origin"] for r in live.effective_queue(obs, guess, points, ts(20)).collect()}
    assert fresh == {"A": "live", "B": "live", "C": "live", "D": "last_known"}
    keys = spark.createDataFrame([("A",), ("B",), ("E",)], "airport string")
    asked = {r["airport"]: (r["effective"], r["origin"]) for r in live.effective_queue(obs, guess, points, ts(21), keys=keys).collect()}
    assert asked == {"A": (1.0, "last_known"), "B": (8.0, "predicted"), "E": (None, None)}


def test_a_skipped_pull_counts_as_a_success(make):
    pulls = make([("EDI", ts(0), 1.0), ("EDI", ts(1), None), ("EDI", ts(2), None)]).withColumn(
        "status", F.element_at(F.array(F.lit("success"), F.lit("skipped"), F.lit("failure")), F.col("id").cast("int")))
    assert health.pull_counts_wide(pulls).first()["successes"] == 2
    assert {round(r["success_rate"], 6) for r in health.success_rate(pulls, 5).collect()} == {0.666667}


def test_a_replayed_batch_replaces_itself(make, spark, tmp_path):
    sink = writers.batch_folders(str(tmp_path / "table"))
    rows = make([("A", ts(0), 1.0), ("B", ts(0), 2.0)])
    for number in (0, 1, 1):
        sink(rows, number)
    assert spark.read.parquet(str(tmp_path / "table")).groupBy("batch").count().orderBy("batch").collect() == [(0, 2), (1, 2)]


# --- offers -------------------------------------------------------------------

def ordered_scan(rows):
    kept = []
    for o in sorted(rows, key=lambda r: (r[5], r[0])):
        if not any(o[1:3] == k[1:3] and abs(o[3] - k[3]) <= timedelta(minutes=20) and abs(o[4] - k[4]) <= 2 for k in kept):
            kept.append(o)
    return {o[0] for o in kept}


def offers(spark, rows):
    data = [(i, a, b, str(t), s, p) for i, a, b, t, s, p in rows]
    return spark.createDataFrame(data, "offer_id string, origin string, destination string, departs string, seats int, price_value double"
                                 ).withColumn("departs", F.col("departs").cast("timestamp_ntz"))


def test_dedup_equals_the_ordered_scan(spark):
    rnd = random.Random(3)
    rows = [(f"o{i:05d}", rnd.choice("AB"), "X", START + timedelta(minutes=rnd.randrange(3 * 1440)), rnd.randrange(1, 9),
             float(rnd.randrange(60))) for i in range(1500)]
    got = {r["offer_id"] for r in dedup_offers(offers(spark, rows)).collect()}
    assert got == ordered_scan(rows)


@pytest.mark.parametrize("falling", [False, True])
def test_dedup_with_chains_longer_than_any_margin(spark, falling):
    """Prices that only rise (or fall) in time: every outcome depends on the one before."""
    n = 600
    rows = [(f"o{i:05d}", "A", "X", START + timedelta(minutes=13 * i), 4, float(n - i if falling else i)) for i in range(n)]
    got = {r["offer_id"] for r in dedup_offers(offers(spark, rows), first_span_hours=3).collect()}
    assert got == ordered_scan(rows)


@pytest.mark.parametrize("most", [1, 5, 1000])
def test_dedup_meets_only_cells_beside_its_own(spark, monkeypatch, most):
    """However wide the cells of time are that kept offers are held by, down to the reach."""
    monkeypatch.setattr("queuetide.operators.dedup.MOST_CELLS", most)
    rnd = random.Random(most)
    rows = [(f"o{i:05d}", "A", "X", START + timedelta(minutes=5 * rnd.randrange(288)), rnd.randrange(1, 12), float(rnd.randrange(90)))
            for i in range(900)]
    got = {r["offer_id"] for r in dedup_offers(offers(spark, rows), first_span_hours=1 + most % 3).collect()}
    assert got == ordered_scan(rows)


def test_offer_without_a_readable_departure_is_kept(spark):
    rows = offers(spark, [("a", "A", "X", START, 1, 5.0), ("b", "A", "X", START, 2, 6.0)])
    broken = rows.withColumn("departs", F.lit(None).cast("timestamp_ntz")).withColumn("offer_id", F.concat(F.lit("n"), "offer_id"))
    assert {r["offer_id"] for r in dedup_offers(rows.unionByName(broken)).collect()} == {"a", "na", "nb"}


# --- sinks ----------------------------------------------------------------------

def test_ids_continue_over_batches(make, spark, tmp_path):
    path = str(tmp_path / "table")
    for part in range(2):
        writers.append_obs(make([("A", ts(i + 10 * part), 1.0) for i in range(7)] + [("A", ts(0), 1.0)] * 3), path)
    ids = [r["id"] for r in spark.read.parquet(path).orderBy("id").collect()]
    assert ids == list(range(1, 21))


def test_writers_at_the_same_time_never_share_an_id(make, spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "table")
    batches = [make([(f"W{w}", ts(i + 10 * part), 1.0) for i in range(w + 3)]).cache() for w in range(3) for part in range(3)]
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda b: writers.append_obs(b, path), batches))
    rows = spark.read.parquet(path)
    total = sum(b.count() for b in batches)
    assert sorted(r["id"] for r in rows.collect()) == list(range(1, total + 1))
    given = writers.ledger(spark, path)
    assert len(given) == 9 and given == sorted(given) and given[-1] == total
    assert rows.select("airport", "timestamp").distinct().count() == total
    import pathlib

    assert not list(pathlib.Path(path).glob("_staged-*"))


def test_only_one_of_many_makes_an_entry(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    files, path = writers._files(spark, str(tmp_path / "entry"))
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda k: writers._create_new(spark, files, path, str(k)), range(40)))
    assert sum(made) == 1 and writers._text(files, path) == str(made.index(True))


def test_snapshots_stay_bounded_and_leased_runs_stay(make, spark, tmp_path):
    import pathlib

    path = str(tmp_path / "forecast")
    rows = make([("A", ts(0), 1.0), ("B", ts(0), 2.0)])
    failing = rows.select(F.raise_error(F.lit("gone")).alias("queue"))

    def size():
        return sum(1 for p in pathlib.Path(path).rglob("*.parquet"))

    sizes = []
    for k in range(1, 9):
        if k % 4 == 0:
            snapshots.refresh(spark, path, k, ts(k), lambda: failing)
        snapshots.publish_forecast(rows.coalesce(1), path, k, ts(k))
        snapshots.expire(spark, path, 3, ts(k))
        sizes.append(size())
    assert max(sizes[3:]) <= 3 * 2 + 2 and {r["run_id"] for r in snapshots.manifest(spark, path).collect()} == {6, 7, 8}
    with snapshots.reading(spark, path, ts(1000)) as held:
        for k in (9, 10, 11):
            snapshots.publish_forecast(rows, path, k, ts(k))
        assert snapshots.expire(spark, path, 1, ts(11)) == [6, 7, 9, 10]
        assert held.count() == 2
        assert snapshots.expire(spark, path, 1, ts(2000)) == [8]  # the lease has ended
    assert snapshots.last_good(spark, path).count() == 2
    with pytest.raises(ValueError):
        snapshots.expire(spark, path, 0, ts(0))


def test_one_failing_sink_does_not_stop_the_rest(make):
    seen = []

    def broken(_):
        raise ValueError("no")

    out = writers.fan_out(make([("A", ts(0), 1.0)]), {"bad": broken, "good": lambda b: seen.append(b.count())})
    assert {r["sink"]: r["status"] for r in out.collect()} == {"bad": "failed", "good": "ok"} and seen == [1]


def test_last_good_survives_a_failed_refresh(make, spark, tmp_path):
    path = str(tmp_path / "forecast")
    assert snapshots.last_good(spark, path) is None

    def build():
        return make([("A", ts(0), 1.0)])

    def failing():
        return build().select(F.raise_error(F.lit("gone")).alias("queue"))

    assert snapshots.refresh(spark, path, 1, ts(0), build) == "ok"
    assert "gone" in snapshots.refresh(spark, path, 2, ts(1), failing)
    assert snapshots.last_good(spark, path).count() == 1


def test_exact_quantiles_match_interpolation(spark):
    rnd = random.Random(5)
    values = {k: [rnd.choice([rnd.random() * 50, 3.25]) for _ in range(n)] for k, n in (("A", 501), ("B", 2), ("C", 1))}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "airport string, duration_s double")
    for r in health.exact_duration_quantiles(df).collect():
        vs = sorted(values[r["airport"]])
        for q, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")):
            at = q * (len(vs) - 1)
            low, high = vs[math.floor(at)], vs[math.ceil(at)]
            assert r[name] == pytest.approx(low + (high - low) * (at - math.floor(at)))
