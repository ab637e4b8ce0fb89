"""What the operators share: the shared folder, written intermediates, batches, groups."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MB = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, one below the warehouse.

    A session without the setting is a test or a laptop; on a cluster the warehouse is
    shared as well.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what follows does not recompute it."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Delete the files of written intermediates whose results are stored elsewhere."""
    for df in frames:
        spark = df.sparkSession
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def crc32_of_id(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 4 * MB) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of ``column`` (one row at least).

    Small neighbours are put together and large batches cut, so that the memory of
    vectorised work depends on neither the row count nor the length of a text.
    """
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        begin = 0
        while begin < batch.num_rows:
            base = ends[begin - 1] if begin else 0
            stop = max(int(np.searchsorted(ends, base + size - total, side="right")), begin + (0 if held else 1))
            if stop > begin:
                held.append(batch.slice(begin, stop - begin))
                total += int(ends[stop - 1] - base)
            begin = stop
            if begin < batch.num_rows or total >= size:
                yield _one(held)
                held, total = [], 0
    if held:
        yield _one(held)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.Table.from_batches(batches).combine_chunks().to_batches(max_chunksize=1 << 31)[0]


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal ``keys`` in sorted input, one table each."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = last is None or any(c[0] != x for c, x in zip(columns, last))
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        last = [c[-1] for c in columns]
        cuts = np.flatnonzero(change)
        if len(cuts) == 0:
            held.append(batch)
            continue
        if cuts[0] > 0:
            held.append(batch.slice(0, cuts[0]))
        if held:
            yield pa.Table.from_batches(held)
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield pa.Table.from_batches([batch.slice(a, b - a)])
        held = [batch.slice(cuts[-1])]
    if held:
        yield pa.Table.from_batches(held)


def grouped(df: DataFrame, keys: list[str], f: Callable, schema: str, parts: int | None = None) -> DataFrame:
    """``f(table)`` for each group of equal keys, many groups to a call of Python.

    Unlike ``applyInArrow`` a small group costs no round trip of its own. The caller
    sees to it that a group has a bounded size.
    """
    dealt = df.repartition(parts, *keys) if parts else df.repartition(*keys)
    dealt = dealt.sortWithinPartitions(*keys)

    def run(batches):
        for table in groups(batches, keys):
            yield from f(table)

    return dealt.mapInArrow(run, schema)
