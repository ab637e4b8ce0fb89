"""Stale-feed alarms: keys that have been silent for longer than their limit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..constants import KEY, LIVE_STALE_MIN, TS
from .windows import event_time

ALARM = f"{KEY} string, last_seen timestamp, alarm_at timestamp"
# State stores that can hold timers; the setting belongs to the session that starts the stream.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stale_feed_alarm(obs: DataFrame, limit_min: int = LIVE_STALE_MIN, late: str = "0 seconds") -> DataFrame:
    """(key, last_seen, alarm_at): one row for each silence longer than ``limit_min``.

    A key's rows with no longer gap between them are a session; it closes, and the alarm
    is out, when the watermark passes its last row by the limit. The state is one row per
    open session. Append mode.
    """
    session = F.session_window(TS, f"{limit_min} minutes")
    return (event_time(obs.select(KEY, TS), late).groupBy(KEY, session.alias("s")).agg(F.max(TS).alias("last_seen"))
            .select(KEY, F.col("last_seen").cast("timestamp_ntz").alias("last_seen"),
                    F.col("s.end").cast("timestamp_ntz").alias("alarm_at")))


class _Watch(StatefulProcessor):
    """Per key the runs of readings that no silence has ended yet, and a timer at the end of each.

    A run is (first, last, seen) in microseconds; one that only the key list opened has not
    been seen. Readings may come in any order within the watermark: they join, extend or
    bridge runs. A run's timer speaks when the watermark passes its end, unless readings
    that came meanwhile have moved the end.
    """

    def __init__(self, limit_us: int):
        self.limit = limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getValueState("runs", "runs array<struct<first: bigint, last: bigint, seen: boolean>>")

    def _read(self) -> list[tuple[int, int, bool]]:
        return [(r[0], r[1], r[2]) for r in self.runs.get()[0]] if self.runs.exists() else []

    def _write(self, runs: list[tuple[int, int, bool]], timers: set[int]) -> None:
        wanted = {(last + self.limit) // 1000 for _, last, _ in runs}
        for at in timers - wanted:
            self.handle.deleteTimer(at)
        for at in wanted - timers:
            self.handle.registerTimer(at)
        if runs:
            self.runs.update((runs,))
        else:
            self.runs.clear()

    def _joined(self, runs: list[tuple[int, int, bool]], moments: list[int]) -> list[tuple[int, int, bool]]:
        out: list[tuple[int, int, bool]] = []
        for first, last, seen in sorted([*runs, *((m, m, True) for m in moments)]):
            if out and first - out[-1][1] <= self.limit:
                out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] or seen)
            else:
                out.append((first, last, seen))
        return out

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        since = initialState["since"].astype("int64").tolist()
        self._write([(m, m, False) for m in since[:1]], set())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        moments = sorted({m for pdf in rows for m in pdf["us"].tolist() if pd.notna(m)})
        runs = self._read()
        timers = {(last + self.limit) // 1000 for _, last, _ in runs}
        if key[0] is not None:
            self._write(self._joined(runs, [int(m) for m in moments]), timers)
        yield pd.DataFrame({KEY: [], "last_seen": [], "alarm_at": []}).astype(
            {KEY: "str", "last_seen": "datetime64[us]", "alarm_at": "datetime64[us]"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        runs = self._read()
        due = [r for r in runs if (r[1] + self.limit) // 1000 <= at]
        left = [r for r in runs if r not in due]
        self._write(left, {(r[1] + self.limit) // 1000 for r in left})
        yield pd.DataFrame({
            KEY: [key[0]] * len(due),
            "last_seen": pd.to_datetime([last if seen else None for _, last, seen in due], unit="us"),
            "alarm_at": pd.to_datetime([last + self.limit for _, last, _ in due], unit="us")})


def standing_alarm(obs: DataFrame, keys: DataFrame, limit_min: int = LIVE_STALE_MIN, late: str = "0 seconds",
                   ticks: DataFrame | None = None) -> DataFrame:
    """(key, last_seen, alarm_at): one row for each silence longer than ``limit_min``, keys never heard of included.

    ``keys`` lists the keys to watch with ``since``, the moment they are expected from: a
    key that has no reading within the limit after it raises an alarm without ``last_seen``.
    Keys outside the list are watched from their first reading. Time goes on with the
    readings of any key and with ``ticks``, a stream of ``timestamp`` alone, so that a key
    is missed even if it was the last one to speak. Readings behind the watermark are
    dropped. Append mode; the session needs the state store ``STATE_STORE``.
    """
    rows = obs.select(KEY, TS)
    if ticks is not None:
        rows = rows.unionByName(ticks.select(F.lit(None).cast("string").alias(KEY), TS))
    rows = event_time(rows, late).withColumn("us", F.unix_micros(TS))
    listed = keys.groupBy(KEY).agg(F.min("since").alias("since")).select(KEY, F.unix_micros(F.col("since").cast("timestamp")).alias("since"))
    out = rows.groupBy(KEY).transformWithStateInPandas(
        _Watch(limit_min * 60_000_000), ALARM, "append", "eventTime", initialState=listed.groupBy(KEY))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("last_seen", "alarm_at")})
