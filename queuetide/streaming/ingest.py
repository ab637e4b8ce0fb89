"""Streaming ingest: payload files to observations, written to several sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sinks.writers import batch_folders, fan_out
from ..sources.feeds import normalise_feeds

PAYLOAD_SCHEMA = "payload_id bigint, fetched_at timestamp_ntz, airport string, payload string"


def payload_stream(spark: SparkSession, path: str, files_per_batch: int = 1000, fmt: str = "parquet") -> DataFrame:
    return (spark.readStream.format(fmt).schema(PAYLOAD_SCHEMA)
            .option("maxFilesPerTrigger", files_per_batch).load(path))


def ingest(payloads: DataFrame, checkpoint_path: str, sinks: dict[str, Callable[[DataFrame, int], None]],
           status_path: str, on_status: Callable[[DataFrame, int], None] | None = None, available_now: bool = True):
    """Start the query: each micro-batch is normalised once and fanned out to the sinks.

    Sinks get the batch and its number, which stays the same when a batch is replayed
    after a restart; see ``batch_folders``. What became of each sink is stored in
    ``status_path``, a folder per batch, and handed to ``on_status``.
    """
    store = batch_folders(status_path)

    def write(batch: DataFrame, number: int) -> None:
        status = fan_out(normalise_feeds(batch), {
            name: lambda rows, sink=sink: sink(rows, number) for name, sink in sinks.items()})
        store(status, number)
        if on_status:
            on_status(status, number)

    writer = payloads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_path)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
