"""Stand-ins of the engine's tables on the driver's tables, in both languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import QUERY_STOPWORDS


#: Tables whose rows cost much work each.
HEAVY = ("documents", "pages", "conversations", "embeddings")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of heavy rows that comes as fewer partitions than the cluster has cores (a small file) is spread over them.

    Large tables have a partition for every file part and are read as they are.
    """
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name in HEAVY and rows.rdd.getNumPartitions() < min(cores, 32) else rows


def title(c: str = "text"):
    return F.split_part(F.coalesce(F.col(c), F.lit("")), F.lit("\n"), F.lit(1))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, text, title, vault_id, language."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("document_id"), "text", title().alias("title"), F.col("source").alias("vault_id"), F.col("lang").alias("language"))


DOCUMENTS = "docs AS (SELECT doc_id AS document_id, text, split_part(coalesce(text, ''), chr(10), 1) AS title, source AS vault_id, lang AS language FROM documents)"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def tokens_sql(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}_]+'))"


def terms_sql(x: str) -> str:
    own = f"[t FOR t IN {tokens_sql(x)} IF len(t) > 1 AND NOT list_contains({listed(QUERY_STOPWORDS)}, t)]"
    zone = f"CASE WHEN contains(lower({x}), 'múi giờ') THEN list_distinct(list_append([t FOR t IN {own} IF t NOT IN ('múi', 'giờ')], 'gmt')) ELSE {own} END"
    return f"CASE WHEN contains(lower({x}), 'ngày theo lịch') THEN list_distinct(list_concat({zone}, ['dương', 'nghỉ', 'lễ', 'tết'])) ELSE {zone} END"


def codes_sql(x: str) -> str:
    return f"[t FOR t IN {tokens_sql(x)} IF regexp_matches(t, '\\p{{N}}') AND (regexp_matches(t, '\\p{{L}}') OR regexp_matches(t, '^\\p{{N}}{{3,}}$'))]"


def share_sql(part: str, whole: str) -> str:
    return f"(CASE WHEN len({whole}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({part}, {whole}))::DOUBLE / len({whole}) END)"


def collapse_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
