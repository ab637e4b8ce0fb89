"""Calendar and clock columns. Input timestamps are TIMESTAMP_NTZ in UTC."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LOCAL_TZ, TS

TWO_PI = 2.0 * math.pi


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_ts(moment) -> Column:
    """A moment given as column, datetime or text, as a TIMESTAMP_NTZ column."""
    if isinstance(moment, Column):
        return moment
    return F.lit(moment).cast("timestamp_ntz")


def resolved(spark, moment):
    """A moment that is computed from data, looked up once; others as they are.

    Plans that name the moment many times would look it up each time. It comes back as
    text, which means the same in every zone.
    """
    if not isinstance(moment, Column):
        return moment
    return spark.range(1).select(moment.cast("timestamp_ntz").cast("string")).first()[0]


def micros(ts) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def moment_key(ts, ident) -> Column:
    """One number that orders by time and then by a non-negative id.

    A fixed-width key lets ``max_by`` aggregate by hash, which a struct would not.
    """
    shifted = micros(ts).cast("decimal(18,0)") * F.lit("10000000000000000000").cast("decimal(20,0)")
    return shifted + col(ident).cast("decimal(19,0)")


def from_micros(us) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def shift(ts, *, minutes: int = 0, days: int = 0) -> Column:
    """``ts`` plus a fixed length of time."""
    return col(ts) + F.expr(f"INTERVAL '{minutes + days * 1440}' MINUTE")


def floor_micros(us: Column, width: int) -> Column:
    """Largest multiple of ``width`` not above ``us``, in whole numbers."""
    return us - F.pmod(us, F.lit(width))


def floor_to(ts, minutes: int) -> Column:
    return from_micros(floor_micros(micros(ts), minutes * 60_000_000))


def ceil_to(ts, minutes: int) -> Column:
    return from_micros(-floor_micros(-micros(ts), minutes * 60_000_000))


def minutes_between(late, early) -> Column:
    """Length in minutes, as a double."""
    return (micros(late) - micros(early)) / F.lit(60_000_000.0)


def steps_between(late, early, step: int) -> Column:
    """Whole grid steps between two grid slots."""
    return ((micros(late) - micros(early)) / F.lit(step * 60_000_000)).cast("int")


def to_local(ts, tz=LOCAL_TZ) -> Column:
    """UTC instant to wall time; ``tz`` is a zone name, a column of names, or None for UTC."""
    if tz is None:
        return col(ts)
    zone = F.lit(tz) if isinstance(tz, str) else tz
    return F.convert_timezone(F.lit("UTC"), zone, col(ts))


def slot_parts(ts, bucket: int = 5) -> dict[str, Column]:
    """weekday (Monday 0), hour, and minute floored to ``bucket``."""
    t = col(ts)
    return {
        "weekday": F.weekday(t).cast("int"),
        "hour": F.hour(t).cast("int"),
        "minute": (F.floor(F.minute(t) / F.lit(bucket)) * bucket).cast("int"),
    }


def wave(position: Column, period: float, name: str) -> dict[str, Column]:
    """Sine and cosine of a position on a cycle."""
    angle = F.lit(TWO_PI) * position / F.lit(period)
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def calendar_features(df: DataFrame, ts: str = TS, tz=LOCAL_TZ, bucket: int = 5) -> DataFrame:
    """month, day, weekday, hour, 5-minute bucket and weekend flag in local time."""
    local = to_local(ts, tz)
    parts = slot_parts(local, bucket)
    return df.withColumns({
        "month": F.month(local).cast("int"),
        "day": F.dayofmonth(local).cast("int"),
        **parts,
        "is_weekend": (parts["weekday"] >= 5).cast("int"),
    })


def cyclical_features(df: DataFrame, ts: str = TS, tz=LOCAL_TZ) -> DataFrame:
    """hour, weekday and time-of-day waves; time of day uses the raw minute."""
    local = to_local(ts, tz)
    of_day = F.hour(local) * 60 + F.minute(local)
    return df.withColumns({
        **wave(F.hour(local), 24.0, "hour"),
        **wave(F.weekday(local), 7.0, "dow"),
        **wave(of_day, 1440.0, "tod"),
    })


def time_covariates(df: DataFrame, ts: str = TS) -> DataFrame:
    """The forecaster's UTC clock covariates, all doubles."""
    t = F.col(ts)
    of_day = F.hour(t) * 60 + F.minute(t)
    return df.withColumns({
        "hour": F.hour(t).cast("double"),
        "minute": F.minute(t).cast("double"),
        "day_of_week": F.weekday(t).cast("double"),
        "is_weekend": (F.weekday(t) >= 5).cast("double"),
        "month": F.month(t).cast("double"),
        **wave(of_day, 1440.0, "tod"),
        **wave(F.weekday(t) * 1440 + of_day, 10080.0, "tow"),
        **wave(F.dayofyear(t), 365.25, "doy"),
    })


def wall_columns(df: DataFrame, ts: str = TS, tz=LOCAL_TZ) -> DataFrame:
    """year, month, day, hour, weekday and date of the key's own zone."""
    local = to_local(ts, tz)
    return df.withColumns({
        "year": F.year(local).cast("int"),
        "month": F.month(local).cast("int"),
        "day": F.dayofmonth(local).cast("int"),
        "hour": F.hour(local).cast("int"),
        "weekday": F.weekday(local).cast("int"),
        "date": F.to_date(local),
    })


def hhmm(ts_text) -> Column:
    """``HH:MM`` of an ISO text; trailing ``Z`` characters are dropped."""
    bare = F.rtrim(col(ts_text), F.lit("Z"))
    return F.date_format(F.try_to_timestamp(bare), "HH:mm")


def parse_utc(text) -> Column:
    """ISO text to UTC: a zone suffix is honoured, none means UTC."""
    c = col(text)
    zoned = c.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    # Spark wants the colon in an offset.
    spaced = F.regexp_replace(c, r"([+-]\d{2})(\d{2})$", "$1:$2")
    read = F.when(zoned, F.try_to_timestamp(spaced)).otherwise(
        F.try_to_timestamp(F.concat(c, F.lit("Z"))))
    return F.coalesce(read, F.try_to_timestamp(c)).cast("timestamp_ntz")


def minutes_remaining(end, as_of) -> Column:
    """Whole minutes left, truncated toward zero."""
    return minutes_between(end, as_ts(as_of)).cast("int")


def hours_remaining(end, as_of) -> Column:
    """Hours left, rounded half up and never below one."""
    hours = minutes_between(end, as_ts(as_of)) / 60.0
    return F.greatest(F.lit(1), F.floor(hours + 0.5).cast("int"))
