"""Latest rows per key, trailing averages, daily lags, row numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..constants import ID, KEY, TS, VALUE
from ..functions.calendar import as_ts, moment_key, wall_columns
from ..functions.numbers import round_up_half
from ..session import materialise

SALTS = 64


def latest_per_key(df: DataFrame, by: str = ID) -> DataFrame:
    """The row with the highest id of each key, by one combinable aggregate.

    ``by`` identifies a row. Columns are picked one by one because fixed-width
    buffers keep the aggregate hash based; a struct would force a sort of the input.
    """
    rest = [c for c in df.columns if c != KEY]
    return df.groupBy(KEY).agg(*[F.max_by(c, by).alias(c) for c in rest]).select(*df.columns)


def last_n_per_key(df: DataFrame, n: int = 24, by: str = ID) -> DataFrame:
    """The ``n`` rows with the highest ids per key, with ``rn`` counting back from 1.

    Ranks are cut per input task first and then per salted share of a key, so a
    hot key's candidates never meet in one task before they are few.
    """
    newest = F.desc(by)
    share = (df.withColumn("_salt", F.spark_partition_id() % SALTS)
             .withColumn("_r", F.row_number().over(W.partitionBy(KEY, "_salt").orderBy(newest)))
             .where(F.col("_r") <= n).drop("_salt", "_r"))
    return (share.withColumn("rn", F.row_number().over(W.partitionBy(KEY).orderBy(newest)))
            .where(F.col("rn") <= n))


def trailing_average(df: DataFrame, n: int = 24, keys: DataFrame | None = None) -> DataFrame:
    """Rounded mean of the last ``n`` rows; a key without rows gives 0."""
    avg = last_n_per_key(df.select(KEY, ID, VALUE), n).groupBy(KEY).agg(
        round_up_half(F.avg(VALUE)).cast("bigint").alias("average"))
    if keys is not None:
        avg = keys.select(KEY).distinct().join(avg, KEY, "left").na.fill(0, ["average"])
    return avg


def historical_comparison(df: DataFrame, as_of) -> DataFrame:
    """Value a day, a calendar month and a year earlier, in one pass.

    The target moments are scalars, so each is a filtered ``max_by``. A month or
    year back clamps to the last day of a shorter month.
    """
    now = as_ts(as_of)
    targets = {
        "yesterday": now - F.expr("INTERVAL '1' DAY"),
        "month": now - F.expr("INTERVAL '1' MONTH"),
        "year": now - F.expr("INTERVAL '12' MONTH"),
    }
    stamp = moment_key(TS, ID) if ID in df.columns else F.col(TS)
    return df.groupBy(KEY).agg(*[
        F.max_by(VALUE, F.when(F.col(TS) <= t, stamp)).alias(name) for name, t in targets.items()])


def daily_average(df: DataFrame, first_hour: int = 7, last_hour: int = 22) -> DataFrame:
    """Mean per (key, local date) over the given hours, both ends in; needs ``date`` and ``hour``."""
    return (df.where(F.col("hour").between(first_hour, last_hour))
            .groupBy(KEY, "date").agg(F.avg(VALUE).alias("average_queue")))


def daily_lag_map(df: DataFrame, daily: DataFrame, lags: dict[str, int] | None = None) -> DataFrame:
    """The daily average of ``date`` minus each lag; no fallback."""
    for name, days in (lags or {"yesterday_average_queue": 1, "lastweek_average_queue": 7}).items():
        moved = daily.select(KEY, F.date_add("date", days).alias("date"), F.col("average_queue").alias(name))
        df = df.join(moved, [KEY, "date"], "left")
    return df


def with_wall_columns(df: DataFrame, zones: DataFrame | None = None, tz: str = "Europe/Copenhagen") -> DataFrame:
    """Calendar columns in each key's own zone (``zones``: key, tz), or in ``tz``."""
    if zones is None:
        return wall_columns(df, TS, tz)
    zoned = df.join(zones, KEY, "left").withColumn("tz", F.coalesce("tz", F.lit(tz)))
    return wall_columns(zoned, TS, F.col("tz")).drop("tz")


def holiday_flag(df: DataFrame, calendar: DataFrame, date: str = "date", name: str = "holiday") -> DataFrame:
    """1 where the row's local date is a holiday of its key."""
    days = calendar.select(KEY, F.col("date").alias(date), F.lit(1).alias(name)).distinct()
    return df.join(days, [KEY, date], "left").na.fill(0, [name])


def name_lookup(df: DataFrame, names: DataFrame, code: str, name: str) -> DataFrame:
    """Name of a code from ``names(code, name)``; the code itself where unknown."""
    known = names.select(F.col("code").alias(code), F.col("name").alias("_n"))
    return df.join(known, code, "left").withColumn(name, F.coalesce("_n", code)).drop("_n")


def number_rows(df: DataFrame, *order) -> DataFrame:
    """``number`` (from 1, in order) and ``total``, without a one-task window.

    Rows are range-sorted, each part counted, and the counts summed over the parts.
    The input is written once, so finding the ranges' bounds reads the order's columns
    and not what made them; the sorted rows are written so both uses see the same parts.
    The order must be total for the numbers to be repeatable.
    """
    rows = (materialise(df, "unnumbered").repartitionByRange(*order).sortWithinPartitions(*order)
            .withColumn("_at", F.monotonically_increasing_id()))
    rows = materialise(rows, "sorted").withColumns({
        "_part": F.shiftright("_at", 33), "_in": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    # One row per part, so this window is as small as the number of tasks.
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"),
                         F.sum("_n").over(W.partitionBy(F.lit(0))).alias("total"))
    # That bound is also what makes the parts safe to broadcast; the sorted rows stay where they are.
    return (rows.join(F.broadcast(parts), "_part").withColumn("number", F.col("_before") + F.col("_in") + 1)
            .drop("_at", "_part", "_in", "_before"))
