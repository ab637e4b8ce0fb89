"""Payload rules of the eleven feeds: JSON text to minutes.

Each rule is a struct column ``(queue, timestamp_text, status)``. One pass over
the payloads picks the rule by key, so no feed rescans the input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import KEY, TS, VALUE
from ..functions.calendar import parse_utc
from ..functions.numbers import round_even

# Names inside the payloads.
MUC_QUEUES = ("T2_Abflug_SIKO_ECO_NORD", "T2_Abflug_SIKO_ECO_SUED")
FRA_CHECKPOINT = "Security checkpoint, Concourse A\r\nDeparture gates: A1 - A69"
DUS_CHECKPOINT = "Sicherheitskontrolle A"
ARN_TERMINAL = "Terminal 5"
LHR_MEASURE = "maximumWaitTime"


# Every field the rules look at. Only one feed has an array as its root.
DOCUMENT = """
queueTimes STRUCT<current: ARRAY<STRUCT<queueId: STRING, projectedWaitTime: DOUBLE>>>,
result STRUCT<gateWaitTime: BIGINT>,
data ARRAY<STRUCT<ps: STRING, status: STRING, name: STRING, waitingTime: BIGINT>>,
t2WaitingTimeInterval STRING, t3WaitingTimeInterval STRING, deliveryId STRING,
queueTimesList ARRAY<STRUCT<locationName: STRING, interval: STRING>>,
T1 STRING, minutes DOUBLE, timeMinutesRounded BIGINT,
VF1 STRUCT<waitTimeInSeconds: DOUBLE>
"""
TERMINALS = "ARRAY<STRUCT<queueMeasurements: ARRAY<STRUCT<name: STRING, value: BIGINT>>>>"
ARRAY_ROOT = "LHR"


def _outcome(queue: Column, when: Column | None = None, missing: str = "failure") -> Column:
    return F.struct(
        queue.cast("double").alias(VALUE),
        (F.lit(None).cast("string") if when is None else when).alias("said_at"),
        F.when(queue.isNull(), missing).otherwise("success").alias("status"),
    )


def _first_int(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d+)", 1).try_cast("bigint")


def _last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def _from_zero(value: Column) -> Column:
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0)))


def _muc(doc: Column) -> Column:
    current = doc["queueTimes"]["current"]

    def reading(queue: str) -> Column:
        """The last positive reading of a queue."""
        wanted = F.filter(current, lambda e: (e["queueId"] == queue) & (e["projectedWaitTime"] > 0))
        return _last(wanted)["projectedWaitTime"]

    raw = F.array_compact(F.array(*map(reading, MUC_QUEUES)))
    # Readings are seconds only when both queues report more than twenty.
    in_seconds = (F.size(raw) == 2) & (F.array_min(raw) > 20)
    best = F.array_min(F.transform(raw, lambda v: F.when(
        in_seconds, F.greatest(F.lit(4.0), round_even(v / 60.0))).otherwise(round_even(v))))
    return _outcome(F.when(current.isNotNull(), F.coalesce(best, F.lit(0.0))))


def _ist(doc: Column) -> Column:
    return _outcome(doc["result"]["gateWaitTime"])


def _lhr(terminals: Column) -> Column:
    readings = F.flatten(F.transform(terminals, lambda e: e["queueMeasurements"]))
    wanted = F.filter(readings, lambda m: (m["name"] == LHR_MEASURE) & m["value"].isNotNull())
    return _outcome(_last(wanted)["value"])


def _fra(doc: Column) -> Column:
    found = F.get(F.filter(doc["data"], lambda e: e["ps"] == FRA_CHECKPOINT), F.lit(0))
    return _outcome(_first_int(found["status"]))


def _dus(doc: Column) -> Column:
    wanted = F.filter(doc["data"], lambda e: (e["name"] == DUS_CHECKPOINT) & e["waitingTime"].isNotNull())
    return _outcome(_last(wanted)["waitingTime"])


def _cph(doc: Column) -> Column:
    numbers = F.regexp_extract_all(
        F.concat_ws(" ", doc["t2WaitingTimeInterval"], doc["t3WaitingTimeInterval"]), F.lit(r"(\d+)"), 1)
    total = F.aggregate(numbers, F.lit(0.0), lambda acc, n: acc + n.cast("double"))
    mean = F.when(F.size(numbers) > 0, total / F.size(numbers))
    said = F.when(F.length(doc["deliveryId"]) > 0, doc["deliveryId"])
    return _outcome(round_even(mean), said)


def _arn(doc: Column) -> Column:
    found = _last(F.filter(doc["queueTimesList"], lambda e: e["locationName"] == ARN_TERMINAL))
    return _outcome(_first_int(found["interval"]))


def _dub(doc: Column) -> Column:
    return _outcome(_from_zero(F.btrim(doc["T1"], F.lit("= ")).try_cast("bigint")))


def _edi(doc: Column) -> Column:
    return _outcome(_from_zero(doc["minutes"]), missing="skipped")


def _osl(doc: Column) -> Column:
    return _outcome(_from_zero(doc["timeMinutesRounded"]))


def _ams(doc: Column) -> Column:
    return _outcome(_from_zero(F.floor(doc["VF1"]["waitTimeInSeconds"] / 60.0)))


RULES: dict[str, Callable[[Column], Column]] = {
    "AMS": _ams, "ARN": _arn, "CPH": _cph, "DUB": _dub, "DUS": _dus, "EDI": _edi,
    "FRA": _fra, "IST": _ist, "LHR": _lhr, "MUC": _muc, "OSL": _osl,
}


def pull_outcomes(payloads: DataFrame, keep_payload: bool = False, feeds: list[str] | None = None) -> DataFrame:
    """All feeds (or the given ones) in one pass; a key without a rule is a failure.

    A payload is parsed once, into the fields of all rules. The outcome goes through
    a generator, which later filters on it cannot be pushed below; they would have
    the whole parse repeated.
    """
    dropped = ("fetched_at", KEY) if keep_payload else ("payload", "fetched_at", KEY)
    others = [c for c in payloads.columns if c not in dropped]
    rooted = F.col(KEY) == ARRAY_ROOT
    parsed = payloads.withColumns({
        "_doc": F.when(~rooted, F.from_json("payload", DOCUMENT)),
        "_list": F.when(rooted, F.from_json("payload", TERMINALS))})
    branches = None
    for feed in feeds or RULES:
        value = RULES[feed](F.col("_list" if feed == ARRAY_ROOT else "_doc"))
        test = F.col(KEY) == feed
        branches = F.when(test, value) if branches is None else branches.when(test, value)
    outcome = branches.otherwise(_outcome(F.lit(None).cast("double")))
    out = parsed.select(*others, KEY, "fetched_at", F.inline(F.array(outcome)))
    said = F.coalesce(parse_utc("said_at"), F.col("fetched_at"))
    return out.select(*others, KEY, F.when(F.col("said_at").isNull(), F.col("fetched_at")).otherwise(said).alias(TS),
                      VALUE, "status")


def read_feed(payloads: DataFrame, feed: str) -> DataFrame:
    """One feed's payloads as pulls."""
    return pull_outcomes(payloads.where(F.col(KEY) == feed), feeds=[feed])


def normalise_feeds(payloads: DataFrame) -> DataFrame:
    """Observations of the pulls that succeeded."""
    return pull_outcomes(payloads).where(F.col("status") == "success").drop("status")


def quarantined(payloads: DataFrame) -> DataFrame:
    """Payloads whose rule failed, with the payload kept for a look."""
    failed = pull_outcomes(payloads, keep_payload=True).where(F.col("status") == "failure")
    return failed.withColumnRenamed("payload", "raw").drop(VALUE, "status")


def read_payload_files(spark, path: str) -> DataFrame:
    """Files laid out as ``airport=XXX/<name>.json[.gz]``, one payload per file."""
    return (spark.read.text(path, wholetext=True)
            .select(F.col(KEY), F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("fetched_at"),
                    F.col("value").alias("payload")))
