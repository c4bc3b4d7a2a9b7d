"""Jobs as a stream: at most one active job of a document and type, kept by state with timers.

Commands of a (document_id, job_type), in order of (ts, seq): ENSURE makes a pending job unless one is active; START runs a pending one;
BEAT says that a running one is alive; COMPLETE, FAIL and CANCEL end an active one. Whatever doesn't apply is refused and changes nothing. A
running job that is not heard of for ``silence`` has failed at that time: found from the next command, or by a timer once the watermark has
passed it. State survives a restart from the checkpoint. A command behind what its key has seen in an earlier micro-batch is dropped, as those behind the
watermark are.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

COMMANDS = "document_id long, job_type string, ts timestamp, seq long, action string"
EVENTS = "document_id long, job_type string, job_no int, status string, at timestamp, reason string"
ENDS = {"COMPLETE": "COMPLETED", "FAIL": "FAILED", "CANCEL": "CANCELLED"}
_STATE = "jobs int, status string, heard long"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Held = tuple[int, str | None, int]  # jobs so far, status of the active one, when the key was last heard of (ms)
Event = tuple[int, str, int, str | None]  # job_no, status, at (ms), reason


def step(held: Held, ts: int, action: str, silence: int) -> tuple[Held, list[Event]]:
    """What a command at ts (ms) does."""
    held, out = silenced(held, ts - 1, silence)
    jobs, status, _ = held
    if action == "ENSURE" and status is None:
        jobs, status = jobs + 1, "PENDING"
        out.append((jobs, "PENDING", ts, None))
    elif action == "START" and status == "PENDING":
        status = "RUNNING"
        out.append((jobs, "RUNNING", ts, None))
    elif action in ENDS and status is not None:
        out.append((jobs, ENDS[action], ts, None))
        status = None
    return (jobs, status, ts), out


def silenced(held: Held, now: int, silence: int) -> tuple[Held, list[Event]]:
    """A running job that wasn't heard of until now has failed."""
    jobs, status, heard = held
    if status == "RUNNING" and heard + silence <= now:
        return (jobs, None, heard), [(jobs, "FAILED", heard + silence, "silence")]
    return held, []


class JobProcessor(StatefulProcessor):
    def __init__(self, silence_ms: int):
        self.silence = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("job", _STATE)

    def _rows(self, key: tuple, events: list[Event]) -> Iterator[pd.DataFrame]:
        if events:
            yield pd.DataFrame([(*key, n, s, at, why) for n, s, at, why in events], columns=["document_id", "job_type", "job_no", "status", "ms", "reason"])

    def _keep(self, before: Held, held: Held) -> None:
        if before[1] == "RUNNING":
            self.handle.deleteTimer(before[2] + self.silence)
        if held[1] == "RUNNING":
            self.handle.registerTimer(held[2] + self.silence)
        self.state.update(held)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before: Held = tuple(self.state.get()) if self.state.exists() else (0, None, -1)
        held, events = before, []
        batch = pd.concat(list(rows)).sort_values(["ms", "seq"], kind="stable")
        for at, action in zip(batch["ms"].tolist(), batch["action"], strict=True):
            if at >= before[2]:
                held, found = step(held, at, action, self.silence)
                events += found
        self._keep(before, held)
        yield from self._rows(key, events)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before: Held = tuple(self.state.get())
        held, events = silenced(before, expiredTimerInfo.getExpiryTimeInMs(), self.silence)
        if events:
            self.state.update(held)
        yield from self._rows(key, events)

    def close(self) -> None:
        pass


def job_events(commands: DataFrame, silence_seconds: int, late: str = "0 seconds") -> DataFrame:
    """EVENTS of a stream of COMMANDS. Times go through the processor as milliseconds, so that no session's time zone touches them."""
    keyed = commands.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts")).groupBy("document_id", "job_type")
    found = keyed.transformWithStateInPandas(JobProcessor(silence_seconds * 1000), EVENTS.replace("at timestamp", "ms long"), "append", "eventTime")
    return found.select("document_id", "job_type", "job_no", "status", F.timestamp_millis("ms").alias("at"), "reason")


@contextmanager
def rocks(spark: SparkSession):
    """Queries started within keep their state in RocksDB, which timers need."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def run(spark: SparkSession, commands: str, target: str, checkpoint: str, silence_seconds: int, late: str = "0 seconds", files: int | None = None) -> StreamingQuery:
    """Works on what a folder of command files has since the last run, and on the timers that the watermark has passed; each batch in a folder of its own."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{target}/batch={number}")

    source = spark.readStream.schema(COMMANDS)
    source = (source if files is None else source.option("maxFilesPerTrigger", files)).parquet(commands)
    with rocks(spark):
        return job_events(source, silence_seconds, late).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def jobs(events: DataFrame) -> DataFrame:
    """One row for each job from its EVENTS: last status, times, whether it fell silent."""
    at = lambda s, f: f(F.when(F.col("status") == s, F.col("at")))
    ended = F.col("status").isin(*ENDS.values())
    return events.groupBy("document_id", "job_type", "job_no").agg(
        F.max_by("status", F.struct("at", F.when(F.col("status") == "PENDING", 0).when(F.col("status") == "RUNNING", 1).otherwise(2))).alias("last_status"), at("PENDING", F.min).alias("created_at"), at("RUNNING", F.min).alias("started_at"), F.max(F.when(ended, F.col("at"))).alias("completed_at"),
        F.count_if(F.col("reason") == "silence").alias("n_silent"),
    )
