"""Counters, gauges, histograms, alerts, traces over observation rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.sources.shared import written

#: Default alert rules.
RULES = (
    ("search_latency_warning", "retrieval.latency_ms", "gt", 2000.0, "WARNING", "Search latency {value}ms exceeds {threshold}ms threshold"),
    ("search_latency_critical", "retrieval.latency_ms", "gt", 5000.0, "CRITICAL", "Search latency {value}ms exceeds critical {threshold}ms threshold"),
    ("generation_latency_warning", "generation.latency_ms", "gt", 5000.0, "WARNING", "Generation latency {value}ms exceeds {threshold}ms threshold"),
    ("generation_latency_critical", "generation.latency_ms", "gt", 15000.0, "CRITICAL", "Generation latency {value}ms exceeds critical {threshold}ms threshold"),
    ("ocr_failure_rate", "ocr.failure_count", "gt", 5.0, "WARNING", "OCR failure count {value} exceeds {threshold}"),
    ("parser_failure_rate", "parser.failure_count", "gt", 5.0, "WARNING", "Parser failure count {value} exceeds {threshold}"),
    ("citation_coverage_low", "citation.coverage", "lt", 0.5, "WARNING", "Citation coverage {value} is below {threshold} threshold"),
)


def rules(spark: SparkSession, values=RULES) -> DataFrame:
    return spark.createDataFrame(list(values), "rule string, metric string, operator string, threshold double, severity string, message_template string")


def counters(observations: DataFrame, keys: list[str]) -> DataFrame:
    return observations.groupBy(*keys).agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"))


def gauges(observations: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Last value of each key."""
    return observations.groupBy(*keys).agg(F.max_by("value", F.struct(*order)).alias("value"))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def order_statistics(observations: DataFrame, keys: list[str], ranks: dict[str, Column], value: str = "value") -> DataFrame:
    """keys and, under each name, the value of a rank (from 1, by an expression over n) among the key's values in order.

    Exact, and no task holds a key, however hot: values are counted, the counts dealt out by ranges of (keys, value) and written once;
    sums by range give each range's start, running counts within a range then tell which of its values a rank falls on.
    Nulls aren't counted; a rank is a number, so that ``0.95 * n`` means the first value with at least that many up to it.
    """
    counts = observations.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    ranged = written(counts.repartitionByRange(*keys, value).withColumn("__range", F.spark_partition_id()), "ranges")
    # A row for each key and range: as many as there are ranges at most, for one key.
    starts = ranged.groupBy(*keys, "__range").agg(F.sum("__n").alias("__here"))
    before = Window.partitionBy(*keys).orderBy("__range")
    starts = starts.withColumn("__upto", F.sum("__here").over(before)).withColumn("__total", F.sum("__here").over(Window.partitionBy(*keys)))
    starts = starts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__range").alias("__r"), (F.col("__upto") - F.col("__here")).alias("__start"), F.col("__upto").alias("__end"), F.col("__total").alias("n"))
    # Only ranges that some rank falls into are looked into.
    names = list(ranks)
    starts = starts.select("*", *[ranks[k].alias(f"__rank_{k}") for k in names])
    starts = starts.where(reduce(lambda x, y: x | y, [(F.col(f"__rank_{k}") > F.col("__start")) & (F.col(f"__rank_{k}") <= F.col("__end")) for k in names]))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    rows = ranged.join(starts, same & (F.col("__range") == F.col("__r")))
    within = Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__last", F.col("__start") + F.sum("__n").over(within))
    hit = lambda k: F.when((F.col(f"__rank_{k}") <= F.col("__last")) & (F.col(f"__rank_{k}") > F.col("__last") - F.col("__n")), F.col(value))
    return rows.groupBy(*keys).agg(*[F.max(hit(k)).alias(k) for k in names])


def histograms(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Count, sum, mean, extremes; p50 is the median, p95 and p99 are the nearest ranks; these three are null where all values are."""
    n = F.col("n")
    found = order_statistics(observations, keys, {"lower": F.floor((n + 1) / 2), "upper": F.floor(n / 2) + 1, "p95": F.lit(0.95) * n, "p99": F.lit(0.99) * n})
    sums = observations.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("sum"), F.round(F.avg("value"), 2).alias("avg"), F.round(F.min("value"), 2).alias("min"), F.round(F.max("value"), 2).alias("max"))
    rows = sums.join(found, _same(sums, found, keys), "left").select(*[sums[k] for k in keys], "n", "sum", "avg", "min", "max", "lower", "upper", "p95", "p99")
    return rows.select(*keys, "n", "sum", "avg", "min", "max", F.round((F.col("lower") + F.col("upper")) / 2, 2).alias("p50"), F.round("p95", 2).alias("p95"), F.round("p99", 2).alias("p99"))


def snapshot(found: DataFrame, name: str) -> DataFrame:
    """metric, value: a histogram's mean under its name, and its mean and p95 under suffixes."""
    return found.select(F.explode(F.array(*[F.struct(F.concat(F.col(name), F.lit(s)).alias("metric"), F.col(c).alias("value")) for s, c in (("", "avg"), ("_avg", "avg"), ("_p95", "p95"))])).alias("x")).select("x.*")


def alerts(values: DataFrame, rule_table: DataFrame) -> DataFrame:
    """Rules that fire on metric values: rule, metric, severity, value, threshold, message. The rule table is small."""
    v, t = F.col("value"), F.col("threshold")
    op = F.col("operator")
    fires = F.when(op == "gt", v > t).when(op == "gte", v >= t).when(op == "lt", v < t).when(op == "lte", v <= t).when(op == "eq", F.abs(v - t) < 1e-9).otherwise(F.lit(False))
    message = F.replace(F.replace("message_template", F.lit("{value}"), v.cast("string")), F.lit("{threshold}"), t.cast("string"))
    return values.join(F.broadcast(rule_table), "metric").where(fires).select("rule", "metric", "severity", "value", "threshold", message.alias("message"))


def traces(spans: DataFrame) -> DataFrame:
    return spans.groupBy("trace_id").agg(F.count("*").alias("n_spans"), F.round(F.sum("duration_ms"), 4).alias("duration_ms"), F.count_if(F.col("error").isNotNull()).alias("n_errors"))


def linked_spans(spans: DataFrame) -> DataFrame:
    """Adds parent_span_id: the span started before in the trace."""
    return spans.withColumn("parent_span_id", F.lag("span_id").over(Window.partitionBy("trace_id").orderBy("start_time", "span_id")))


def health(checks: DataFrame) -> DataFrame:
    return checks.groupBy("service").agg(F.when(F.bool_or(F.col("status") == "unhealthy"), "degraded").otherwise("healthy").alias("status"))


def windowed(observations: DataFrame, keys: list[str], time: str = "ts", width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts and sums by tumbling window; with late, for streams, what comes later than that is dropped."""
    rows = observations.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if late else observations
    return rows.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(*keys, F.col("window.start").alias("start"), "n", "total")
