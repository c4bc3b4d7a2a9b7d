"""Retrieval and citation metrics, reports, regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall(hits: Column, total: Column, k: Column | int) -> Column:
    """min(hits / total, 1); 1 for nothing to find, else 0 for k = 0."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.when(total == 0, F.lit(1.0)).when(k == 0, F.lit(0.0)).otherwise(F.least(hits / F.nullif(total, F.lit(0)), F.lit(1.0)))


def precision(hits: Column, k: Column | int) -> Column:
    k = F.lit(k) if isinstance(k, int) else k
    return F.when(k == 0, F.lit(0.0)).otherwise(hits / F.nullif(k, F.lit(0)))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / F.nullif(p + r, F.lit(0.0)))


def at_cutoffs(expected: DataFrame, retrieved: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """The rows of at_k for several k, with k as first column: both sides are worked out and joined once."""
    want = expected.distinct().withColumn("wanted", F.lit(1))
    top = retrieved.where(F.col("rank") <= max(ks))
    rows = want.join(top, ["query_id", "item"], "full_outer")
    hit = lambda k: F.when(F.col("wanted").isNotNull() & (F.col("rank") <= k), F.col("rank"))
    counts = rows.groupBy("query_id").agg(F.count("wanted").alias("total"), *[x for k in ks for x in (F.count(hit(k)).alias(f"hits{k}"), F.min(hit(k)).alias(f"first{k}"))])
    each = counts.select("query_id", "total", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"hits{k}").alias("hits"), F.col(f"first{k}").alias("first_hit")) for k in ks])).alias("at"))
    out = each.select("at.k", "query_id", "total", "at.hits", "at.first_hit")
    r, p = recall(F.col("hits"), F.col("total"), F.col("k")), precision(F.col("hits"), F.col("k"))
    return out.select("k", "query_id", "total", "hits", F.round(r, 6).alias("recall"), F.round(p, 6).alias("precision"), F.round(f1(p, r), 6).alias("f1"), F.round(F.coalesce(1 / F.col("first_hit"), F.lit(0.0)), 6).alias("reciprocal_rank"))


def at_k(expected: DataFrame, retrieved: DataFrame, k: int = 10) -> DataFrame:
    """Of each query: hits, total, recall, precision, F1 and reciprocal rank of the first hit.

    expected: query_id, item; retrieved: query_id, item, rank. Queries are those of either side.
    """
    return at_cutoffs(expected, retrieved, (k,)).drop("k")


def mean_reciprocal_rank(rows: DataFrame) -> DataFrame:
    return rows.agg(F.round(F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)), 6).alias("mrr"), F.count("*").alias("n_queries"))


def ndcg(graded: DataFrame, k: int = 10) -> DataFrame:
    """nDCG@k of each query over what it retrieved: query_id, rank, relevance."""
    ideal = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), F.asc("rank")))
    rows = graded.withColumn("ideal", ideal)
    gain = lambda place: F.sum(F.when(F.col(place) <= k, (F.pow(F.lit(2.0), F.col("relevance")) - 1) / F.log2(F.col(place) + 1.0)))
    out = rows.groupBy("query_id").agg(gain("rank").alias("dcg"), gain("ideal").alias("best"))
    return out.select("query_id", F.round(F.when(F.coalesce("best", F.lit(0.0)) == 0, F.lit(0.0)).otherwise(F.col("dcg") / F.nullif(F.col("best"), F.lit(0.0))), 6).alias("ndcg"))


def citation_scores(pairs: DataFrame) -> DataFrame:
    """Adds precision (1 for no citation), recall (1 for none expected), F1. pairs: generated, expected, correct."""
    p = F.when(F.col("generated") == 0, F.lit(1.0)).otherwise(F.col("correct") / F.nullif(F.col("generated"), F.lit(0)))
    r = F.when(F.col("expected") == 0, F.lit(1.0)).otherwise(F.col("correct") / F.nullif(F.col("expected"), F.lit(0)))
    return pairs.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(f1(p, r), 6)})


def verdicts(rows: DataFrame, least_recall: float = 0.5) -> DataFrame:
    """Adds passed and failure to the rows of at_k."""
    ok = F.col("recall") >= least_recall
    return rows.withColumns({"passed": ok, "failure": F.when(~ok, F.lit("RETRIEVAL"))})


def report(rows: DataFrame, component: str = "retrieval", by: tuple[str, ...] = ()) -> DataFrame:
    """Long table component, metric, value: means of the metrics and the share that passed (1 for none); by: of each group, these columns first."""
    means = rows.groupBy(*by).agg(*[F.round(F.avg(m), 6).alias(m) for m in ("recall", "precision", "f1", "reciprocal_rank")], F.round(F.coalesce(F.avg(F.col("passed").cast("int")), F.lit(1.0)), 6).alias("pass_rate"))
    return means.unpivot(list(by), ["recall", "precision", "f1", "reciprocal_rank", "pass_rate"], "metric", "value").select(*by, F.lit(component).alias("component"), "metric", "value")


def regressions(baseline: DataFrame, current: DataFrame, gap: float = 0.05) -> DataFrame:
    """component, metric, baseline, current, difference, status; a metric without a baseline is unchanged."""
    return compared(current.join(baseline.withColumnRenamed("value", "baseline"), ["component", "metric"], "left"), gap)


def compared(rows: DataFrame, gap: float = 0.05) -> DataFrame:
    """The rows of regressions from component, metric, baseline (or null), value."""
    rows = rows.withColumn("baseline", F.coalesce("baseline", "value"))
    diff = F.round(F.col("value") - F.col("baseline"), 4)
    status = F.when(F.col("value") - F.col("baseline") < -gap, "REGRESSION").when(F.col("value") - F.col("baseline") > gap, "IMPROVEMENT").otherwise("UNCHANGED")
    return rows.select("component", "metric", F.round("baseline", 4).alias("baseline"), F.round("value", 4).alias("current"), diff.alias("difference"), status.alias("status"))


def sample_cases(spark, n: int = 10) -> DataFrame:
    """Generated benchmark cases."""
    i = F.col("id")
    return spark.range(1, n + 1).select(
        F.format_string("case-%03d", i).alias("id"), F.lit("1.0").alias("version"), F.format_string("Case %d", i).alias("title"), F.when(i % 3 == 0, "citation").when(i % 3 == 1, "retrieval").otherwise("generation").alias("category"),
        F.when(i % 2 == 0, "hard").otherwise("easy").alias("difficulty"), F.lit("vi").alias("language"), F.format_string("Question %d?", i).alias("question"), F.array(F.format_string("doc-%d", i)).alias("expected_documents"),
    )


def case_verdicts(rows: DataFrame, least_recall: float = 0.5, least_precision: float = 0.5) -> DataFrame:
    """answer_id, retrieval, citation, generation, pipeline, failure (the first component that failed).

    rows: answer_id, recall, precision, n_chars, abstained, should_abstain. An answer that should abstain passes generation
    if it does; another if it says something and doesn't abstain.
    """
    generation = F.when(F.col("should_abstain"), F.col("abstained")).otherwise(~F.col("abstained") & (F.col("n_chars") > 0))
    out = rows.select("answer_id", (F.col("recall") >= least_recall).alias("retrieval"), (F.col("precision") >= least_precision).alias("citation"), generation.alias("generation"))
    failure = F.when(~F.col("retrieval"), "RETRIEVAL").when(~F.col("citation"), "CITATION").when(~F.col("generation"), "GENERATION")
    return out.withColumns({"pipeline": F.col("retrieval") & F.col("citation") & F.col("generation"), "failure": failure})


def component_report(verdicts_: DataFrame) -> DataFrame:
    """Cases, passes and pass rate of each component."""
    parts = ["retrieval", "citation", "generation", "pipeline"]
    long = verdicts_.unpivot("answer_id", parts, "component", "passed")
    return long.groupBy("component").agg(F.count("*").alias("n_cases"), F.count_if("passed").alias("n_passed"), F.round(F.count_if("passed") / F.count("*"), 6).alias("pass_rate"))
