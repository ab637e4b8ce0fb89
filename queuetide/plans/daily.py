"""Daily-lag feature table: calendar in the key's own zone, holiday, daily averages
of yesterday and last week, one row per grid point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import ID, KEY, TS, VALUE
from ..functions.calendar import to_local, wall_columns
from ..functions.numbers import one_hot, round_even
from ..operators.grid import drop_duplicate_ts, resample_ffill
from ..operators.latest import daily_average, daily_lag_map, holiday_flag

LAGS = ["yesterday_average_queue", "lastweek_average_queue"]
WHOLE = [VALUE, "year", "month", "day", "hour", "weekday", "holiday"]


def cast_ints(df: DataFrame, whole: list[str], rounded: list[str]) -> DataFrame:
    """Truncate ``whole`` columns to integers; round the ``rounded`` ones half-even first."""
    return df.withColumns({**{c: F.col(c).cast("bigint") for c in whole},
                           **{c: round_even(c).cast("bigint") for c in rounded}})


def daily_features(obs: DataFrame, holidays: DataFrame, zones: DataFrame | None = None,
                   tz: str = "Europe/Copenhagen", step: int = 5, dummies: list[str] | None = None) -> DataFrame:
    """The feature table on a ``step``-minute grid of local time.

    Rows that lack a value or one of the two daily averages are dropped. Daily
    averages are over the raw rows, as the grid repeats values across gaps.
    """
    if zones is None:
        df = obs.withColumn(TS, to_local(TS, tz))
    else:
        df = obs.join(zones, KEY, "left").withColumn(TS, to_local(TS, F.coalesce("tz", F.lit(tz)))).drop("tz")
    df = wall_columns(df, TS, None)
    daily = daily_average(df)
    # Values first, then the lookups: the lags are a function of the carried row's date.
    carried = resample_ffill(drop_duplicate_ts(df), step)
    out = holiday_flag(carried, holidays)
    out = daily_lag_map(out, daily).where(F.col(VALUE).isNotNull())
    out = out.where(F.col(LAGS[0]).isNotNull() & F.col(LAGS[1]).isNotNull())
    out = cast_ints(out, WHOLE, LAGS)
    if dummies:
        out = out.withColumns(one_hot(KEY, dummies, "is_"))
    return out.drop(ID, "date")
