import json

import pytest
from pyspark.sql import functions as F

from queuetide.sources import feeds
from queuetide.sources.offers import load_offers

FRA = "Security checkpoint, Concourse A\r\nDeparture gates: A1 - A69"


def muc(north, south):
    rows = [{"queueId": q, "projectedWaitTime": v} for q, v in zip(feeds.MUC_QUEUES, (north, south))]
    return {"queueTimes": {"current": rows + [{"queueId": "OTHER", "projectedWaitTime": 1}]}}


CASES = [
    ("MUC", muc(7, 12), 7.0, "success"),
    ("MUC", muc(300, 1200), 5.0, "success"),          # both above twenty: seconds
    ("MUC", muc(60, 1200), 4.0, "success"),           # at least four minutes
    ("MUC", muc(20, 1200), 20.0, "success"),          # one is not above twenty: minutes
    ("MUC", muc(0, -5), 0.0, "success"),
    ("MUC", muc(None, 600), 600.0, "success"),
    ("MUC", {"queueTimes": {"current": muc(9, None)["queueTimes"]["current"][:1] + muc(6, None)["queueTimes"]["current"][:1]}}, 6.0, "success"),
    ("MUC", {"closed": True}, None, "failure"),
    ("IST", {"result": {"gateWaitTime": 12}}, 12.0, "success"),
    ("IST", {"result": {"gateWaitTime": "12"}}, None, "failure"),
    ("LHR", [{"queueMeasurements": [{"name": "maximumWaitTime", "value": 3}]},
             {"queueMeasurements": [{"name": "maximumWaitTime", "value": -1}, {"name": "x", "value": 9}]}], -1.0, "success"),
    ("LHR", [{"queueMeasurements": [{"name": "maximumWaitTime", "value": None}]}], None, "failure"),
    ("FRA", {"data": [{"ps": "Other", "status": "9"}, {"ps": FRA, "status": "5 to 10 min"}, {"ps": FRA, "status": "77"}]}, 5.0, "success"),
    ("FRA", {"data": [{"ps": FRA, "status": "closed"}]}, None, "failure"),
    ("DUS", {"data": [{"name": "Sicherheitskontrolle A", "waitingTime": 2}, {"name": "Sicherheitskontrolle A", "waitingTime": 8},
                      {"name": "Sicherheitskontrolle A", "waitingTime": None}]}, 8.0, "success"),
    ("CPH", {"t2WaitingTimeInterval": "10-15", "t3WaitingTimeInterval": "> 20 min"}, 15.0, "success"),
    ("CPH", {"t2WaitingTimeInterval": "2-3", "t3WaitingTimeInterval": None}, 2.0, "success"),   # 2.5 goes to even
    ("CPH", {"t2WaitingTimeInterval": None, "t3WaitingTimeInterval": "closed"}, None, "failure"),
    ("ARN", {"queueTimesList": [{"locationName": "Terminal 5", "interval": "1-2"}, {"locationName": "Terminal 5", "interval": "5-10 min"}]}, 5.0, "success"),
    ("ARN", {"queueTimesList": [{"locationName": "Terminal 2", "interval": "1-2"}]}, None, "failure"),
    ("DUB", {"T1": "= 11"}, 11.0, "success"),
    ("DUB", {"T1": " -4 "}, 0.0, "success"),
    ("DUB", {"T2": "5"}, None, "failure"),
    ("EDI", {"minutes": 4, "queue": 217}, 4.0, "success"),
    ("EDI", {"minutes": -4}, 0.0, "success"),
    ("EDI", {"queue": 217}, None, "skipped"),
    ("OSL", {"timeMinutesRounded": -1}, 0.0, "success"),
    ("OSL", {}, None, "failure"),
    ("AMS", {"VF1": {"waitTimeInSeconds": 179}}, 2.0, "success"),
    ("AMS", {"VF1": {"waitTimeInSeconds": -30}}, 0.0, "success"),
    ("AMS", {"VF2": {}}, None, "failure"),
    ("XXX", {}, None, "failure"),
]


@pytest.fixture(scope="module")
def outcomes(spark):
    rows = [(i, "2026-01-01 10:00:00", a, json.dumps(p)) for i, (a, p, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "payload_id bigint, fetched_at string, airport string, payload string").withColumn(
        "fetched_at", F.col("fetched_at").cast("timestamp_ntz"))
    return {r["payload_id"]: r for r in feeds.pull_outcomes(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)), ids=[f"{c[0]}-{i}" for i, c in enumerate(CASES)])
def test_feed_rule(outcomes, i):
    _, _, queue, status = CASES[i]
    assert (outcomes[i]["queue"], outcomes[i]["status"]) == (queue, status)


def test_delivery_time_and_quarantine(spark):
    rows = [(1, "CPH", '{"t2WaitingTimeInterval":"4","deliveryId":"2026-01-01T09:55:00"}'), (2, "CPH", "not json"),
            (3, "EDI", "not json")]
    df = spark.createDataFrame(rows, "payload_id bigint, airport string, payload string").withColumn(
        "fetched_at", F.lit("2026-01-01 10:00:00").cast("timestamp_ntz"))
    good = feeds.normalise_feeds(df).collect()
    assert [(r["payload_id"], str(r["timestamp"])) for r in good] == [(1, "2026-01-01 09:55:00")]
    assert [(r["payload_id"], r["raw"]) for r in feeds.quarantined(df).collect()] == [(2, "not json")]


def test_offer_files_with_either_root(spark, tmp_path):
    offer = {"numberOfBookableSeats": 3, "price": {"total": "10.00", "currency": "DKK"}, "itineraries": []}
    (tmp_path / "a.json").write_text(json.dumps([offer, offer]))
    (tmp_path / "b.json").write_text(json.dumps({"data": [offer]}))
    (tmp_path / "c.json").write_text(json.dumps({"meta": 1}))
    got = load_offers(spark, str(tmp_path)).groupBy("file").count().collect()
    assert sorted(r["count"] for r in got) == [1, 2]
