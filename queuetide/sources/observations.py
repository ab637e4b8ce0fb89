"""Reading and cleaning the observation table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import HISTORY_DAYS, ID, KEY, MAX_VALUE, TRAIN_DAYS, TS, VALUE
from ..functions.calendar import as_ts

SCHEMA = T.StructType([
    T.StructField(ID, T.LongType()),
    T.StructField(VALUE, T.DoubleType()),
    T.StructField(TS, T.TimestampNTZType()),
    T.StructField(KEY, T.StringType()),
])


def read_observations(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """The table from any Spark source; files get the schema rather than a guess."""
    reader = spark.read.format(fmt).options(**options)
    if fmt in ("csv", "json", "parquet", "orc"):
        reader = reader.schema(SCHEMA)
    return reader.load(path) if path else reader.load()


def scan_obs(df: DataFrame, keys: list[str] | None = None, since=None, until=None,
             columns: list[str] | None = None, order: list | None = None,
             limit: int | None = None) -> DataFrame:
    """Filter, project, order and limit; filters and columns reach the file scan."""
    if keys is not None:
        df = df.where(F.col(KEY).isin(keys))
    if since is not None:
        df = df.where(F.col(TS) >= as_ts(since))
    if until is not None:
        df = df.where(F.col(TS) <= as_ts(until))
    if order:
        df = df.orderBy(*order)
    if limit is not None:
        df = df.limit(limit)
    return df.select(*columns) if columns else df


def typed(df: DataFrame) -> DataFrame:
    """Timestamp and value in their types; what cannot be read becomes NULL."""
    kinds = dict(df.dtypes)
    ts, value = F.col(TS), F.col(VALUE)
    if kinds[TS] == "string":
        ts = F.try_to_timestamp(ts).cast("timestamp_ntz")
    elif kinds[TS] != "timestamp_ntz":
        ts = ts.cast("timestamp_ntz")
    if kinds[VALUE] != "double":
        value = value.try_cast("double")
    return df.withColumns({TS: ts, VALUE: value})


def clean_obs(df: DataFrame, drop_negative: bool = False, max_value: float | None = MAX_VALUE) -> DataFrame:
    """Readable rows only; a negative reading can be taken as unknown and dropped.

    On a typed table the limits are plain comparisons and reach the file scan.
    """
    df = typed(df).where(F.col(TS).isNotNull() & F.col(VALUE).isNotNull() & ~F.isnan(VALUE))
    if max_value is not None:
        df = df.where(F.col(VALUE) < max_value)
    if drop_negative:
        df = df.where(F.col(VALUE) >= 0)
    return df


def latest_moment(df: DataFrame, ts: str = TS):
    """Newest timestamp as a scalar column; stands in for the wall clock."""
    return df.agg(F.max(ts)).scalar()


def history_window(df: DataFrame, as_of, days: int = HISTORY_DAYS) -> DataFrame:
    """Rows no older than ``days``; with a literal ``as_of`` partitions are pruned."""
    return df.where(F.col(TS) >= as_ts(as_of) - F.expr(f"INTERVAL '{days}' DAY"))


def since_last_n_days(df: DataFrame, as_of, days: int = TRAIN_DAYS) -> DataFrame:
    """The trainer's window."""
    return history_window(df, as_of, days)


def completeness(df: DataFrame, manifest: DataFrame) -> DataFrame:
    """One status row: rows received against the manifest's ``expected_rows``.

    An unknown total (NULL) passes.
    """
    expected = manifest.agg(F.max("expected_rows")).scalar()
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("expected_rows", expected).withColumn(
        "status", F.when(F.col("rows") < F.col("expected_rows"), "truncated").otherwise("ok"))


def assert_complete(df: DataFrame, expected_rows: int | None) -> DataFrame:
    """``df`` itself; running it fails when rows are missing. Unknown total passes."""
    if expected_rows is None:
        return df
    rows = df.agg(F.count(F.lit(1))).scalar()
    message = F.concat(F.lit("history truncated: received "), rows.cast("string"),
                       F.lit(f" of {expected_rows} rows"))
    return df.where(F.when(rows < expected_rows, F.raise_error(message).cast("boolean")).otherwise(True))
