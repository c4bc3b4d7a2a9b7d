"""Structured Streaming: ingestion of new documents, state checks, windowed metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tesserae.operators.lifecycle import TRANSITIONS
from tesserae.operators.observability import windowed
from tesserae.operators.registry import latest


def documents(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """A stream of the documents that arrive in a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def process(stream: DataFrame, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs work on every micro-batch and appends its rows to target, each batch in a folder of its own.

    A batch that is repeated after a failure overwrites its own folder, so rows come out once.
    """

    def batch(df: DataFrame, number: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def checked_states(events: DataFrame) -> DataFrame:
    """Adds previous and valid to a stream of (document_id, seq, state), keeping each document's last state."""
    allowed = frozenset(TRANSITIONS)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, now in zip(rows["seq"], rows["state"], strict=True):
            out.append((key[0], seq, now, last, now == "UPLOADED" if last is None else (last, now) in allowed))
            last = now
        state.update((last,))
        yield pd.DataFrame(out, columns=["document_id", "seq", "state", "previous", "valid"])

    return events.groupBy("document_id").applyInPandasWithState(fold, "document_id long, seq long, state string, previous string, valid boolean", "last string", "append", "NoTimeout")


def windowed_metrics(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts and sums by hour and event type of a stream of events."""
    return windowed(events, ["event_type"], "ts", "1 hour", late)


def updated(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes every group that a micro-batch changes to the batch's folder in target; state that the watermark has passed is dropped."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """The last state of each group that ``updated`` has written."""
    return latest(spark.read.parquet(target), keys, "batch").drop("batch")
