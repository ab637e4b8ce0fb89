"""Appending observations, writing to several sinks, documents, run history."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ID, KEY, TS, VALUE
from ..operators.latest import latest_per_key, number_rows
from ..session import checkpoint


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _files(spark: SparkSession, path: str):
    """The file system of ``path`` and the path as it knows it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _text(files, path) -> str:
    stream = files.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _create_new(spark: SparkSession, files, path, text: str) -> bool:
    """Make a file that is not there; False if it is. Local disks need the call that does both at once."""
    try:
        if files.getUri().getScheme() == "file":
            nio = spark._jvm.java.nio.file
            files.mkdirs(path.getParent())
            options = spark.sparkContext._gateway.new_array(nio.OpenOption, 2)
            options[0], options[1] = nio.StandardOpenOption.CREATE_NEW, nio.StandardOpenOption.WRITE
            nio.Files.write(spark._jvm.java.io.File(path.toUri().getPath()).toPath(), bytearray(text.encode()), options)
        else:
            stream = files.create(path, False)
            stream.write(bytearray(text.encode()))
            stream.close()
    except Py4JJavaError:
        if not files.exists(path):
            raise
        return False
    return True


def ledger(spark: SparkSession, path: str) -> list[int]:
    """The highest id given out by each entry of a table's id ledger, in the order they were made."""
    files, folder = _files(spark, f"{path}/_ledger")
    if not files.exists(folder):
        return []
    entries = sorted((int(f.getPath().getName()), f.getPath()) for f in files.listStatus(folder) if f.getPath().getName().isdigit())
    out = []
    for number, entry in entries:
        if number != len(out):
            raise ValueError(f"entry {len(out)} of the id ledger of {path} is missing")
        out.append(_text(files, entry))
    # The newest entry may have been made, but not filled, a moment ago.
    return [int(t) if t else -1 for t in out]


def _reserve(spark: SparkSession, path: str, n: int, patience: float = 30.0) -> int:
    """The highest id given out so far, after entering ``n`` more in the ledger.

    Entries are consecutive, and each is a file that only one writer can create: who
    loses looks again and tries the next one. The entry is made before rows are written,
    so a run that fails leaves ids unused, never a double id. A table without a ledger is
    searched for its highest id. The store must refuse to create a file that exists.
    """
    files, folder = _files(spark, f"{path}/_ledger")
    until = time.monotonic() + patience
    while True:
        given = ledger(spark, path)
        if given and given[-1] < 0:
            if time.monotonic() > until:
                raise TimeoutError(f"entry {len(given) - 1} of the id ledger of {path} stays empty: its writer died while making it")
            time.sleep(0.05)
            continue
        if given:
            start = given[-1]
        else:
            start = spark.read.schema(f"{ID} bigint").parquet(path).agg(F.coalesce(F.max(ID), F.lit(0))).first()[0] if _exists(spark, path) else 0
        if not n:
            return start
        entry = spark._jvm.org.apache.hadoop.fs.Path(folder, f"{len(given):012d}")
        if _create_new(spark, files, entry, str(start + n)):
            return start
        until = time.monotonic() + patience


def _moved_in(spark: SparkSession, staged: str, path: str) -> None:
    """Move the data files of a staged write below ``path``; Spark names each file uniquely."""
    files, source = _files(spark, staged)
    root = files.makeQualified(source).toString()
    listed = files.listFiles(source, True)
    while listed.hasNext():
        at = listed.next().getPath()
        if at.getName().startswith(("_", ".")):
            continue
        to = spark._jvm.org.apache.hadoop.fs.Path(path + at.toString().removeprefix(root))
        files.mkdirs(to.getParent())
        if not files.rename(at, to):
            raise OSError(f"{at} was not moved to {to}")
    files.delete(source, True)


def append_obs(batch: DataFrame, path: str, default_ts=None) -> None:
    """Append rows with new ids, partitioned by date.

    Ids continue after the highest one given out, in (timestamp, key, value) order. Any
    number of writers may append at the same time: each takes its ids from the ledger,
    writes to a folder of its own, and moves the files in. A missing timestamp takes
    ``default_ts``.
    """
    spark = batch.sparkSession
    if default_ts is not None:
        batch = batch.withColumn(TS, F.coalesce(F.col(TS), default_ts))
    # The last column tells equal rows apart, so that a run of them can be spread over tasks.
    rows = number_rows(batch.select(KEY, TS, VALUE, F.monotonically_increasing_id().alias("_tie")), TS, KEY, VALUE, "_tie")
    some = rows.select("total").first()
    start = _reserve(spark, path, some["total"] if some else 0)
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    (rows.select((F.col("number") + start).cast("bigint").alias(ID), VALUE, TS, KEY, F.to_date(TS).alias("date"))
     .write.partitionBy("date").parquet(staged))
    _moved_in(spark, staged, path)


def fan_out(batch: DataFrame, sinks: dict[str, Callable[[DataFrame], None]]) -> DataFrame:
    """Write one batch to every sink. A sink's failure is recorded and the rest still run.

    The batch is checkpointed first, so all sinks get the same rows and the source
    is read once.
    """
    spark = batch.sparkSession
    frozen = checkpoint(batch)
    status = []
    for name, write in sinks.items():
        try:
            write(frozen)
            status.append((name, "ok", None))
        except Exception as error:  # noqa: BLE001 - each sink reports for itself
            status.append((name, "failed", f"{type(error).__name__}: {error}"))
    return spark.createDataFrame(status, "sink string, status string, error string")


def batch_folders(path: str) -> Callable[[DataFrame, int], None]:
    """A sink with a folder per batch (partition column ``batch``): a batch that is replayed replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest_documents(obs: DataFrame) -> DataFrame:
    """Latest row per key as an all-text document with the id as document key."""
    text = {c: F.col(c).cast("string") for c in (ID, VALUE, TS, KEY)}
    latest = latest_per_key(obs.select(ID, VALUE, TS, KEY))
    return latest.select(F.col(ID).cast("string").alias("document_id"),
                         F.to_json(F.struct(*[v.alias(k) for k, v in text.items()])).alias("document"))


def append_run(summary: DataFrame, path: str, generated_at) -> None:
    """Append the overall scores of a backtest run to the history."""
    (summary.where("horizon = 'ALL'")
     .select(F.lit(generated_at).cast("timestamp_ntz").alias("generated_at"), "model", "mae", "rmse", "wql")
     .write.mode("append").parquet(path))


def training_metadata(grid: DataFrame, metrics: DataFrame, trained_at, train_days: int, holdout_days: int) -> DataFrame:
    """One row that describes a training run."""
    span = grid.agg(F.count(F.lit(1)).alias("n_train_full"), F.count_distinct(KEY).alias("airports"),
                    (F.max("slot") - F.expr(f"INTERVAL '{holdout_days}' DAY")).alias("cutoff"))
    scores = metrics.agg(*[F.first(c).alias(c) for c in metrics.columns])
    for c in scores.columns:
        span = span.withColumn(c, scores.select(c).scalar())
    return span.withColumns({"trained_at": F.lit(trained_at).cast("timestamp_ntz"),
                             "train_days": F.lit(train_days), "holdout_days": F.lit(holdout_days)})


