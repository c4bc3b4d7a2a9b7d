"""Processing states, jobs, release checks: folds of ordered events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.operators.registry import latest

#: Allowed transitions.
FORWARD = (("UPLOADED", "OCR_PENDING"), ("OCR_PENDING", "OCR_RUNNING"), ("OCR_RUNNING", "OCR_COMPLETED"), ("OCR_COMPLETED", "PARSING_PENDING"), ("PARSING_PENDING", "PARSING_RUNNING"), ("PARSING_RUNNING", "READY"), ("READY", "ARCHIVED"))
IN_FLIGHT = ("UPLOADED", "OCR_PENDING", "OCR_RUNNING", "OCR_COMPLETED", "PARSING_PENDING", "PARSING_RUNNING")
TRANSITIONS = FORWARD + tuple((s, "FAILED") for s in IN_FLIGHT)
STATES = (*IN_FLIGHT, "READY", "ARCHIVED", "FAILED")


def transition_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRANSITIONS, "previous string, state string")


def checked_transitions(events: DataFrame) -> DataFrame:
    """Adds previous state and validity to events (document_id, seq, state); a document starts with UPLOADED."""
    doc = Window.partitionBy("document_id").orderBy("seq")
    rows = events.withColumn("previous", F.lag("state").over(doc))
    allowed = transition_table(events.sparkSession).withColumn("allowed", F.lit(True))
    joined = rows.join(F.broadcast(allowed), ["previous", "state"], "left")
    return joined.select(*events.columns, "previous", F.when(F.col("previous").isNull(), F.col("state") == "UPLOADED").otherwise(F.coalesce("allowed", F.lit(False))).alias("valid"))


def current_states(events: DataFrame) -> DataFrame:
    return latest(events, ["document_id"], "seq")


def first_claims(claims: DataFrame) -> DataFrame:
    """Adds won: of the claims of one (document_id, from_state) the earliest holds."""
    first = F.row_number().over(Window.partitionBy("document_id", "from_state").orderBy("seq"))
    return claims.withColumn("won", first == 1)


def jobs(events: DataFrame) -> DataFrame:
    """One row per job from its events (job_id, document_id, job_type, status, ts): last status, times, duration in ms."""
    at = lambda s, f: f(F.when(F.col("status") == s, F.col("ts")))
    out = events.groupBy("job_id", "document_id", "job_type").agg(
        F.max_by("status", F.struct("ts", "status")).alias("last_status"), F.min("ts").alias("created_at"), at("RUNNING", F.min).alias("started_at"), F.max(F.when(F.col("status").isin("COMPLETED", "FAILED"), F.col("ts"))).alias("completed_at")
    )
    return out.withColumn("duration_ms", (F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1000)


def recovered(rows: DataFrame) -> DataFrame:
    """Jobs after a restart: what was running has failed."""
    return rows.withColumn("last_status", F.when(F.col("last_status") == "RUNNING", "FAILED").otherwise(F.col("last_status")))


def contested(rows: DataFrame) -> DataFrame:
    """(document_id, job_type) with more than one active job."""
    active = rows.where(F.col("last_status").isin("PENDING", "RUNNING"))
    return active.groupBy("document_id", "job_type").agg(F.count("*").alias("n_active")).where("n_active > 1")


def release_report(checks: DataFrame) -> DataFrame:
    """Of each release: totals by status, critical failures, pass rate without skips (1 for none), whether it can go."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = checks.groupBy("release_id").agg(F.count("*").alias("total"), n("PASS").alias("passed"), n("FAIL").alias("failed"), n("SKIP").alias("skipped"), F.count_if((F.col("status") == "FAIL") & F.col("critical")).alias("critical_failures"))
    rate = F.when(F.col("total") == F.col("skipped"), F.lit(1.0)).otherwise(F.col("passed") / F.nullif(F.col("total") - F.col("skipped"), F.lit(0)))
    return out.withColumns({"pass_rate": F.round(rate, 6), "can_release": F.col("critical_failures") == 0})
