"""Observability queries: events are observations, their types are metric names; and streaming runs over files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import observability as ob
from tesserae.plans.common import table
from tesserae.sources.shared import fresh, shared_dir

#: Rules over the names that the driver's events have.
RULES = tuple((f"{e}_{s.lower()}", e + suffix, op, limit, s, "{value} against {threshold}") for e, suffix, op, limit, s in (("click", "", "gt", 40.0, "WARNING"), ("view", "_p95", "gt", 120.0, "CRITICAL"), ("purchase", "_avg", "lt", 60.0, "WARNING"), ("login", "", "gte", 1.0, "WARNING"), ("signup", "_p95", "lte", 1.0, "CRITICAL")))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), "user_id", "value", "ts", "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


def metric_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ob.counters(observations(spark, sf_dir).withColumn("label", F.col("k") % 4), ["name", "label"])


def metric_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ob.gauges(observations(spark, sf_dir), ["name", "user_id"], "ts", "event_id")


def metric_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ob.histograms(observations(spark, sf_dir), ["name"])


def alerts_fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    fired = ob.alerts(ob.snapshot(metric_histogram(spark, sf_dir), "name"), ob.rules(spark, RULES))
    return fired.select("rule", "metric", "severity", "value", "threshold")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of a day are a trace."""
    o = observations(spark, sf_dir)
    return o.select(F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("trace_id"), F.col("event_id").alias("span_id"), F.col("ts").alias("start_time"), F.col("value").alias("duration_ms"), F.when(F.col("name") == "purchase", "error").alias("error"))


def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ob.traces(spans(spark, sf_dir))


def span_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ob.linked_spans(spans(spark, sf_dir)).select("trace_id", "span_id", "parent_span_id")


def service_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = observations(spark, sf_dir).select(F.col("user_id").alias("service"), F.when(F.col("value") > 150, "unhealthy").otherwise("ok").alias("status"))
    return ob.health(checks)


def windowed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ob.windowed(observations(spark, sf_dir), ["name"])


def streamed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed metrics by a stream that reads the events file and ends when it has."""
    from tesserae.streaming.ingest import windowed_metrics as stream

    from tesserae.streaming.ingest import newest, updated

    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    folder = f"{shared_dir(spark).rstrip('/')}/tesserae/streams/{uuid.uuid4().hex}"
    updated(stream(source), f"{folder}/rows", f"{folder}/state").awaitTermination()
    return newest(spark, f"{folder}/rows", ["event_type", "start"]).select(F.col("event_type").alias("name"), F.col("start").cast("timestamp_ntz").alias("start"), "n", "total")


SILENCE = 1801
ACTIONS = ("ENSURE", "ENSURE", "ENSURE", "START", "START", "BEAT", "COMPLETE", "FAIL", "CANCEL")


def job_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of conversations as commands: three conversations are a document's, times are whole even seconds."""
    c, t = F.col("conv_id"), F.col("turn")
    seconds = F.lit(1704067200) + (c % 3) * 14400 + t * 700 + (c % 97) * 2
    action = F.get(F.array(*map(F.lit, ACTIONS)), ((c * 7 + t * 4) % len(ACTIONS)).cast("int"))
    rows = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    return rows.select(F.expr("conv_id div 3").alias("document_id"), F.when(c % 2 == 0, "ocr").otherwise("parse").alias("job_type"), F.timestamp_seconds(seconds).alias("ts"), (c * 1000 + t).cast("long").alias("seq"), action.alias("action"))


def job_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every job that the commands make, by a stream that ends when it has read them: times in seconds, null where a job hasn't come so far."""
    from tesserae.streaming import jobs

    folder = fresh(spark, "jobs")
    job_commands(spark, sf_dir).write.parquet(f"{folder}/commands")
    jobs.run(spark, f"{folder}/commands", f"{folder}/events", f"{folder}/state", SILENCE).awaitTermination()
    found = jobs.jobs(spark.read.schema(jobs.EVENTS).parquet(f"{folder}/events"))
    return found.select("document_id", "job_type", "job_no", "last_status", *[F.unix_seconds(c).alias(c) for c in ("created_at", "started_at", "completed_at")], "n_silent")


_JOBS_SQL = f"""WITH c AS (SELECT conv_id // 3 AS document_id, CASE WHEN conv_id % 2 = 0 THEN 'ocr' ELSE 'parse' END AS job_type, 1704067200 + (conv_id % 3) * 14400 + turn * 700 + (conv_id % 97) * 2 AS t, conv_id * 1000 + turn AS seq, {list(ACTIONS)!r}[(conv_id * 7 + turn * 4) % {len(ACTIONS)} + 1] AS a FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
typed AS (SELECT document_id, job_type, {{'j': 0, 's': '', 'h': -1::BIGINT, 'e': []::STRUCT(n INTEGER, s VARCHAR, w BIGINT, why VARCHAR)[], 't': t::BIGINT, 'a': a}} AS x, t, seq FROM c),
lists AS (SELECT document_id, job_type, list(x ORDER BY t, seq) AS l FROM typed GROUP BY ALL),
folded AS (SELECT document_id, job_type, list_reduce(l, lambda p, x: {{
  'j': p.j + CASE WHEN x.a = 'ENSURE' AND (p.s = '' OR (p.s = 'RUNNING' AND p.h + {SILENCE} < x.t)) THEN 1 ELSE 0 END,
  's': CASE WHEN p.s = '' OR (p.s = 'RUNNING' AND p.h + {SILENCE} < x.t) THEN CASE WHEN x.a = 'ENSURE' THEN 'PENDING' ELSE '' END WHEN x.a IN ('COMPLETE', 'FAIL', 'CANCEL') THEN '' WHEN x.a = 'START' THEN 'RUNNING' ELSE p.s END,
  'h': x.t,
  'e': list_concat(list_concat(p.e, CASE WHEN p.s = 'RUNNING' AND p.h + {SILENCE} < x.t THEN [{{'n': p.j, 's': 'FAILED', 'w': p.h + {SILENCE}, 'why': 'silence'}}] ELSE [] END),
    CASE WHEN p.s = '' OR (p.s = 'RUNNING' AND p.h + {SILENCE} < x.t) THEN CASE WHEN x.a = 'ENSURE' THEN [{{'n': p.j + 1, 's': 'PENDING', 'w': x.t, 'why': NULL}}] ELSE [] END
    WHEN x.a = 'START' AND p.s = 'PENDING' THEN [{{'n': p.j, 's': 'RUNNING', 'w': x.t, 'why': NULL}}]
    WHEN x.a IN ('COMPLETE', 'FAIL', 'CANCEL') THEN [{{'n': p.j, 's': CASE x.a WHEN 'COMPLETE' THEN 'COMPLETED' WHEN 'FAIL' THEN 'FAILED' ELSE 'CANCELLED' END, 'w': x.t, 'why': NULL}}] ELSE [] END),
  't': x.t, 'a': x.a}}, {{'j': 0, 's': '', 'h': -1::BIGINT, 'e': []::STRUCT(n INTEGER, s VARCHAR, w BIGINT, why VARCHAR)[], 't': 0::BIGINT, 'a': ''}}) AS f FROM lists),
events AS (SELECT document_id, job_type, unnest(list_concat(f.e, CASE WHEN f.s = 'RUNNING' AND f.h + {SILENCE} <= (SELECT max(t) FROM c) THEN [{{'n': f.j, 's': 'FAILED', 'w': f.h + {SILENCE}, 'why': 'silence'}}] ELSE [] END)) AS e FROM folded)
SELECT document_id, job_type, e.n AS job_no, arg_max(e.s, e.w * 4 + CASE e.s WHEN 'PENDING' THEN 0 WHEN 'RUNNING' THEN 1 ELSE 2 END) AS last_status, min(e.w) FILTER (e.s = 'PENDING') AS created_at, min(e.w) FILTER (e.s = 'RUNNING') AS started_at, max(e.w) FILTER (e.s IN ('COMPLETED', 'FAILED', 'CANCELLED')) AS completed_at, count(*) FILTER (e.why = 'silence') AS n_silent
FROM events GROUP BY ALL"""


GAP = 1201


def _session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_commands(spark, sf_dir).select("document_id", "ts", (F.col("action") == "FAIL").alias("error"))


def session_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's commands in sessions, over whole tables."""
    from tesserae.streaming import joins

    found = joins.sessions(_session_events(spark, sf_dir), ["document_id"], f"{GAP} seconds")
    return found.select("document_id", F.unix_seconds("start").alias("start"), F.unix_seconds("end").alias("end"), "n", "n_errors")


def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions that have ended by the last command, by a stream."""
    from tesserae.streaming import joins

    folder = fresh(spark, "sessions")
    _session_events(spark, sf_dir).write.parquet(f"{folder}/events")
    stream = joins.sessions(spark.readStream.schema("document_id long, ts timestamp, error boolean").parquet(f"{folder}/events"), ["document_id"], f"{GAP} seconds", "0 seconds")
    joins.appended(stream, f"{folder}/rows", f"{folder}/state").awaitTermination()
    rows = spark.read.schema("document_id long, start timestamp, end timestamp, n long, n_errors long").parquet(f"{folder}/rows")
    return rows.select("document_id", F.unix_seconds("start").alias("start"), F.unix_seconds("end").alias("end"), "n", "n_errors")


_SESSIONS = f"""c AS (SELECT conv_id // 3 AS document_id, 1704067200 + (conv_id % 3) * 14400 + turn * 700 + (conv_id % 97) * 2 AS t, {list(ACTIONS)!r}[(conv_id * 7 + turn * 4) % {len(ACTIONS)} + 1] = 'FAIL' AS bad FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
marked AS (SELECT *, coalesce(t - lag(t) OVER w >= {GAP}, true) AS fresh FROM c WINDOW w AS (PARTITION BY document_id ORDER BY t)),
numbered AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY document_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM marked),
sessions AS (SELECT document_id, min(t) AS start, max(t) + {GAP} AS "end", count(*) AS n, count(*) FILTER (bad) AS n_errors FROM numbered GROUP BY document_id, k)"""

HOUR = 3600


def _uploads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as uploads, and up to three states of each within some two hours."""
    d, i = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL"), F.col("doc_id")
    seconds = F.lit(1704067200) + (i % 5000) * 8
    uploads = d.select(i.alias("document_id"), F.timestamp_seconds(seconds).alias("uploaded_at"), F.col("source").alias("vault_id"))
    k = F.col("k")
    states = d.select(i.alias("document_id"), seconds.alias("s"), F.explode(F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(1), (i % 4).cast("int"))).alias("k"))
    return uploads, states.select("document_id", F.timestamp_seconds(F.col("s") + (F.col("document_id") * k * 13) % 7200 + 1).alias("at"), F.concat(F.lit("S"), k.cast("string")).alias("state"))


def joined_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads with their states of the first hour, by two streams that meet."""
    from tesserae.streaming import joins

    folder, sides = fresh(spark, "uploads"), _uploads(spark, sf_dir)
    for name, df in zip(("uploads", "states"), sides, strict=True):
        df.write.parquet(f"{folder}/{name}")
    read = lambda name, df: spark.readStream.schema(df.schema).parquet(f"{folder}/{name}")
    joins.appended(joins.within(read("uploads", sides[0]), read("states", sides[1]), f"{HOUR} SECONDS", "0 seconds"), f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    rows = spark.read.schema("document_id long, uploaded_at timestamp, vault_id string, at timestamp, state string").parquet(f"{folder}/rows")
    return rows.groupBy("vault_id", "state").agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("n_documents"), F.sum(F.unix_seconds("at") - F.unix_seconds("uploaded_at")).alias("seconds"))


_JOINED_SQL = f"""WITH u AS (SELECT doc_id, source, unnest(range(1, doc_id % 4 + 1)) AS k FROM documents WHERE doc_id IS NOT NULL)
SELECT source AS vault_id, 'S' || k AS state, count(*) AS n, count(DISTINCT doc_id) AS n_documents, sum((doc_id * k * 13) % 7200 + 1)::BIGINT AS seconds FROM u WHERE (doc_id * k * 13) % 7200 + 1 <= {HOUR} GROUP BY ALL"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.sources.files import log_lines as lines

    entries = observations(spark, sf_dir).select(F.when(F.col("value") > 150, "ERROR").when(F.col("value") > 75, "WARNING").otherwise("DEBUG").alias("level"), "name", "event_id")
    return lines(entries, "WARNING")


_OBS = "obs AS (SELECT event_type AS name, user_id, value, ts, event_id, (props->>'$.k')::INTEGER AS k FROM events)"
_HIST = f"{_OBS}, hist AS (SELECT name, count(*) AS n, round(sum(value), 2) AS sum, round(avg(value), 2) AS avg, round(min(value), 2) AS min, round(max(value), 2) AS max, round(median(value), 2) AS p50, round(quantile_disc(value, 0.95), 2) AS p95, round(quantile_disc(value, 0.99), 2) AS p99 FROM obs GROUP BY name)"
_SPANS = f"{_OBS}, spans AS (SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS trace_id, event_id AS span_id, ts, value, name = 'purchase' AS bad FROM obs)"
_RULE_ROWS = ", ".join(f"('{r}', '{m}', '{o}', {t}::DOUBLE, '{s}')" for r, m, o, t, s, _ in RULES)
_WINDOWED = f"WITH {_OBS} SELECT name, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM obs GROUP BY ALL"

QUERIES = {
    "metric_counters": metric_counters,
    "metric_gauges": metric_gauges,
    "metric_histogram": metric_histogram,
    "alerts_fired": alerts_fired,
    "trace_summary": trace_summary,
    "span_parents": span_parents,
    "service_health": service_health,
    "windowed_metrics": windowed_metrics,
    "streamed_metrics": streamed_metrics,
    "log_lines": log_lines,
    "job_stream": job_stream,
    "session_traces": session_traces,
    "streamed_sessions": streamed_sessions,
    "joined_uploads": joined_uploads,
}
SQL = {
    "metric_counters": f"WITH {_OBS} SELECT name, k % 4 AS label, round(sum(value), 4) AS total, count(*) AS n FROM obs GROUP BY ALL",
    "metric_gauges": f"WITH {_OBS} SELECT name, user_id, arg_max(value, {{'t': ts, 'e': event_id}}) AS value FROM obs GROUP BY ALL",
    "metric_histogram": f"WITH {_HIST} SELECT * FROM hist",
    "alerts_fired": f"""WITH {_HIST}, rules(rule, metric, op, threshold, severity) AS (VALUES {_RULE_ROWS}),
vals AS (SELECT name AS metric, avg AS value FROM hist UNION ALL SELECT name || '_avg', avg FROM hist UNION ALL SELECT name || '_p95', p95 FROM hist)
SELECT rule, metric, severity, value, threshold FROM vals JOIN rules USING (metric) WHERE CASE op WHEN 'gt' THEN value > threshold WHEN 'gte' THEN value >= threshold WHEN 'lt' THEN value < threshold WHEN 'lte' THEN value <= threshold ELSE abs(value - threshold) < 1e-9 END""",
    "trace_summary": f"WITH {_SPANS} SELECT trace_id, count(*) AS n_spans, round(sum(value), 4) AS duration_ms, count(*) FILTER (bad) AS n_errors FROM spans GROUP BY trace_id",
    "span_parents": f"WITH {_SPANS} SELECT trace_id, span_id, lag(span_id) OVER (PARTITION BY trace_id ORDER BY ts, span_id) AS parent_span_id FROM spans",
    "service_health": f"WITH {_OBS} SELECT user_id AS service, CASE WHEN bool_or(value > 150) THEN 'degraded' ELSE 'healthy' END AS status FROM obs GROUP BY user_id",
    "windowed_metrics": _WINDOWED,
    "streamed_metrics": _WINDOWED,
    "job_stream": _JOBS_SQL,
    "session_traces": f"WITH {_SESSIONS} SELECT * FROM sessions",
    "streamed_sessions": f"""WITH {_SESSIONS} SELECT * FROM sessions WHERE "end" <= (SELECT max(t) FROM c)""",
    "joined_uploads": _JOINED_SQL,
    "log_lines": f"""WITH {_OBS}, l AS (SELECT CASE WHEN value > 150 THEN 'ERROR' WHEN value > 75 THEN 'WARNING' ELSE 'DEBUG' END AS level, name, event_id FROM obs)
SELECT '{{"level":"' || level || '","name":"' || name || '","event_id":' || event_id || '}}' AS value FROM l WHERE level != 'DEBUG'""",
}
