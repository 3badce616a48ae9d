"""Resumable ingestion with Structured Streaming: bounded batches, a checkpoint as the set of what is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession


def arriving(spark: SparkSession, path: str, schema, files_per_batch: int = 4, fmt: str = "parquet") -> DataFrame:
    """Files as they arrive, a bounded number in each batch."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def drain(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Work off all that is there, batch by batch, then stop; a later call goes on from the checkpoint."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Blocked(Exception):
    """A batch holds an answer that refuses access."""


def drain_until_blocked(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], blocked: str) -> bool:
    """As ``drain``, but a batch with a row where ``blocked`` holds stops the run before it is worked off; whether that happened.

    That batch is not done: a later call begins with it.
    """

    def watched(batch: DataFrame, number: int) -> None:
        if batch.filter(blocked).limit(1).count():
            raise Blocked(f"batch {number}")
        each(batch, number)

    try:
        drain(stream, checkpoint, watched)
    except StreamingQueryException as e:
        if "Blocked" not in str(e):
            raise
        return True
    return False


def append_lines(stream: DataFrame, path: str, checkpoint: str) -> None:
    stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
