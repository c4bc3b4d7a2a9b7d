"""Streams that meet: uploads with the states and jobs of their documents, and sessions of a document's events.

Both sides of a join carry a watermark and meet within a stated interval, so that a row's state can go once the other side's watermark has passed all that could
still match it. Rows behind their side's watermark are dropped; how far behind rows may come is the ``late`` of each side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def within(uploads: DataFrame, states: DataFrame, interval: str, late: str, how: str = "inner") -> DataFrame:
    """States (document_id, at, state, ...) of an upload (document_id, uploaded_at, ...) up to an interval after it.

    how: inner; or leftOuter, where an upload without a state comes out once no more can come for it.
    """
    a = uploads.withWatermark("uploaded_at", late).alias("a")
    b = states.withWatermark("at", late).select(F.col("document_id").alias("state_document"), *[c for c in states.columns if c != "document_id"]).alias("b")
    near = F.expr(f"b.state_document = a.document_id AND b.at >= a.uploaded_at AND b.at <= a.uploaded_at + INTERVAL {interval}")
    return a.join(b, near, how).drop("state_document")


def sessions(events: DataFrame, keys: list[str], gap: str, late: str | None = None, time: str = "ts") -> DataFrame:
    """Sessions of each key: start, end (the last event plus gap), n, number of errors. Events less than gap apart are one session.

    As a stream (late is given), a session comes out once the watermark has passed its end.
    """
    rows = events.withWatermark(time, late) if late else events
    window = F.session_window(time, gap)
    out = rows.groupBy(*keys, window.alias("session")).agg(F.count("*").alias("n"), F.count_if("error").alias("n_errors"))
    return out.select(*keys, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n", "n_errors")


def appended(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes what comes out, each micro-batch in a folder of its own that a repeated batch overwrites."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
