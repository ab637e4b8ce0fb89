"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is a run of frames, each holding up to ``frame_ids`` little-endian unsigned 32-bit
ids, and a skippable frame that lists every frame's compressed size, plain size and the
low 32 bits of the XXH64 of its plain bytes. Any zstandard tool reads the whole file;
a reader that wants some documents reads the table and only their frames.

The index, a Parquet table beside the files, has one row per document: doc_id, file,
shard, row (place among the shard's documents), at (ids before it in the file), n_tokens
(with the end id). Its rows come from the tasks that Spark commits and name the files
these wrote, so a file left by a lost executor is never read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MB, fresh_path, slices
from .tokens import encoder, tokenizer_path

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "doc_id long, file string, shard int, row long, at long, n_tokens long"


class FrameWriter:
    """Appends ids; a frame is closed when it holds ``frame_ids``."""

    def __init__(self, sink, frame_ids: int = 1 << 16, level: int = 3):
        self.sink, self.frame_ids = sink, frame_ids
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.table: list[tuple[int, int, int]] = []

    def append(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.frame_ids:
            whole = np.concatenate(self.held)
            full = self.n_held // self.frame_ids * self.frame_ids
            for a in range(0, full, self.frame_ids):
                self._frame(whole[a:a + self.frame_ids])
            self.held, self.n_held = [whole[full:]], self.n_held - full

    def _frame(self, ids: np.ndarray) -> None:
        plain = ids.astype("<u4", copy=False).tobytes()
        packed = self.compressor.compress(plain)
        self.sink.write(packed)
        self.table.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.n_held:
            self._frame(np.concatenate(self.held))
        entries = b"".join(struct.pack("<III", *e) for e in self.table)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries)
        self.sink.write(struct.pack("<IBI", len(self.table), 0x80, SEEKABLE))


class FrameReader:
    """Ids from a seekable source; decompresses only the frames asked for and checks each."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        source.seek(size - 9 - 12 * n)
        table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.first = np.concatenate([[0], np.cumsum(table[:, 1])]) // 4
        self.sums = table[:, 2]
        self.last: tuple[int, np.ndarray] | None = None

    def frame(self, k: int) -> np.ndarray:
        if self.last is None or self.last[0] != k:
            self.source.seek(int(self.at[k]))
            plain = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.at[k + 1] - self.at[k])))
            if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} does not have its checksum")
            self.last = (k, np.frombuffer(plain, "<u4"))
        return self.last[1]

    def read(self, at: int, n: int) -> np.ndarray:
        if at < 0 or at + n > self.first[-1]:
            raise ValueError("ids beyond the end of the file")
        parts = []
        k = int(np.searchsorted(self.first, at, side="right")) - 1
        while n > 0:
            ids = self.frame(k)[at - self.first[k]:][:n]
            parts.append(ids)
            at, n, k = at + len(ids), n - len(ids), k + 1
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0,
                 frame_ids: int = 1 << 16) -> DataFrame:
    """Encode ``text`` and write the ids below ``folder``; returns the index.

    Files follow ascending doc_id, and so do documents in a file. A null text is empty
    and has the end id alone; rows without a doc_id come first; rows that share a doc_id
    stand side by side, in the order of their texts' hashes. Only doc_id and text are
    read. A text's ids are held in memory at once, a file's never.
    """
    spark = docs.sparkSession
    path = tokenizer or tokenizer_path()
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("doc_id", "text").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    data = f"{folder.rstrip('/')}/data"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.zst"
        fs, where = pafs.FileSystem.from_uri(data)
        fs.create_dir(where, recursive=True)
        sink = writer = None
        row = at = 0
        try:
            for batch in slices(batches, size=8 * MB):
                if writer is None:
                    sink = fs.open_output_stream(f"{where}/{name}", compression=None)
                    writer = FrameWriter(sink, frame_ids)
                ids, first = encoder(path).encode(batch.column("text"), end_id)
                writer.append(ids)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([name] * n), pa.array(np.full(n, shard, np.int32)),
                     pa.array(np.arange(row, row + n)), pa.array(first[:-1] + at), pa.array(np.diff(first))],
                    names=["doc_id", "file", "shard", "row", "at", "n_tokens"])
                row, at = row + n, at + int(first[-1])
            if writer is not None:
                writer.close()
        finally:
            if sink is not None:
                sink.close()

    dealt.mapInArrow(write, INDEX).write.parquet(f"{folder.rstrip('/')}/index")
    return token_index(spark, folder)


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder.rstrip('/')}/index")


def global_starts(index: DataFrame) -> DataFrame:
    """The index with ``start``: ids of all documents before it. The window runs over one row per file."""
    files = index.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return index.join(files, "shard").withColumn("start", F.col("_before") + F.col("at")).drop("_before")


def read_tokens(index: DataFrame, folder: str) -> DataFrame:
    """The index rows given, with ``ids`` (binary, little-endian unsigned 32-bit) read from the files.

    Filter the index first to read some documents: other frames are not touched.
    """
    data = f"{folder.rstrip('/')}/data"
    slim = index.drop("ids")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = pafs.FileSystem.from_uri(data)
        name = reader = source = None
        for batch in batches:
            files, at, n = (batch.column(c).to_pylist() for c in ("file", "at", "n_tokens"))
            out, held, begin = [], 0, 0
            for i in range(batch.num_rows):
                if files[i] != name:
                    if source is not None:
                        source.close()
                    name = files[i]
                    source = fs.open_input_file(f"{where}/{name}")
                    reader = FrameReader(source)
                out.append(reader.read(at[i], n[i]).tobytes())
                held += len(out[-1])
                if held > 8 * MB or i + 1 == batch.num_rows:
                    part = batch.slice(begin, i + 1 - begin)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())],
                                                     names=[*part.schema.names, "ids"])
                    out, held, begin = [], 0, i + 1
        if source is not None:
            source.close()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields)
    return slim.mapInArrow(read, f"{fields}, ids binary")


def token_round_trip(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write the documents' ids, read every file back, and digest what was read."""
    folder = fresh_path(spark, "tokens")
    starts = global_starts(write_tokens(docs, folder))
    slim = starts.select("doc_id", "start", "file", "at", "n_tokens")
    back = read_tokens(slim, folder)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.crc32("ids").alias("ids_crc32"))
