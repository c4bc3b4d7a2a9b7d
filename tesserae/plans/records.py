"""Queries over stores of records: results, metadata, questions, audit, reports, uploads, streams; each written and read again where the operator is a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text as tx
from tesserae.operators import admin, artefacts, registry, structure
from tesserae.plans import maintenance as pm
from tesserae.plans import structure as ps
from tesserae.plans.common import table
from tesserae.sources import files
from tesserae.sources.shared import fresh
from tesserae.streaming import ingest


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")


def page_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a confidence in 64ths, by their ids."""
    confidence = ((F.col("document_id") + F.col("line_no") * 7) % 64) / F.lit(64.0)
    return files.page_confidence(ps.plain_lines(spark, sf_dir).withColumn("confidence", confidence))


def meaningful_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.has_text(ps.plain_lines(spark, sf_dir), 500)


def newest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of every document, a second one for every third, in two appends: the newest of each version."""
    path, i = fresh(spark, "results"), F.col("doc_id")
    d = _documents(spark, sf_dir).select(i.alias("document_id"), (i % 2).alias("version_id"), F.length(F.coalesce("text", F.lit(""))).alias("n_chars"))
    artefacts.append(d.withColumns({"created_at": F.lit(1), "engine": F.lit("digital")}), path)
    artefacts.append(d.where("document_id % 3 = 0").withColumns({"created_at": F.lit(2), "engine": F.lit("image")}), path)
    return artefacts.newest(spark, path).groupBy("version_id", "engine").agg(F.count("*").alias("n"), F.sum("n_chars").cast("long").alias("n_chars"))


def metadata_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and source of a document as its metadata, over which two patches by its labels go."""
    d = _documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.create_map(F.lit("lang"), F.coalesce("lang", F.lit("-")), F.lit("source"), F.coalesce("source", F.lit("-"))).alias("metadata"))
    labels = table(spark, sf_dir, "labels")
    first = labels.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("at"), F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("lang"), F.lit("xx")).alias("metadata"))
    second = labels.where("toxic = 1").select(F.col("doc_id").alias("document_id"), F.lit(2).alias("at"), F.create_map(F.lit("quality"), F.lit("bad")).alias("metadata"))
    merged = registry.merge_metadata(d, first.unionByName(second))
    entries = F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return merged.select("document_id", F.array_join(entries, ";").alias("metadata"))


def question_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions as JSON lines, written and read: each with its category, and whether its text came back."""
    path, b = fresh(spark, "questions"), table(spark, sf_dir, "benchmark")
    rows = b.select(F.col("item_id").cast("string").alias("id"), F.when(F.col("item_id") % 3 == 0, "lookup").otherwise("summary").alias("category"), F.col("text").alias("query"), (F.col("item_id") % 7 == 0).alias("should_abstain"))
    rows.write.json(path)
    return files.read_questions(spark, path).select("id", "category", F.sha2("query", 256).alias("query_sha256"), "should_abstain", F.col("ground_truth").isNull().alias("open"))


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of registered and of read documents, appended one after the other: by day, event and severity."""
    path, i = fresh(spark, "audit"), F.col("doc_id")
    d = _documents(spark, sf_dir)
    common = [F.lit("registry").alias("service"), F.lit("document").alias("entity_type"), i.cast("string").alias("entity_id"), F.lit("m").alias("message"), F.timestamp_seconds(F.lit(1704067200) + i * 3600 % (86400 * 20)).alias("at")]
    for event, some, severity in (("create", F.lit(True), "INFO"), ("read", i % 4 == 0, "WARN")):
        files.append_audit(d.where(some).select(*common, F.lit(event).alias("event"), F.lit(severity).alias("severity")), path)
    return files.read_audit(spark, path).groupBy("day", "event", "severity").agg(F.count("*").alias("n"))


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of documents and characters by source, written and read."""
    path = fresh(spark, "report")
    rows = _documents(spark, sf_dir).groupBy(F.col("source").alias("component")).agg(F.count("*").cast("double").alias("documents"), F.sum(F.length(F.coalesce("text", F.lit("")))).cast("double").alias("characters"))
    files.write_report(rows.unpivot("component", ["documents", "characters"], "metric", "value"), path)
    return files.read_report(spark, path)


def decoded_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as base64 payloads, every second one with a data-URL head, decoded again."""
    p = table(spark, sf_dir, "pages")
    data = F.translate(F.base64(F.encode("html", "UTF-8")), "\r\n", "")
    payloads = p.select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("data:text/html;base64,"), data)).otherwise(data).alias("data"))
    return admin.decoded_upload(payloads).select("page_id", F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("n_bytes"))


def streamed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that arrive in a folder, their tokens estimated by a stream: by language."""
    folder = fresh(spark, "arrivals")
    _documents(spark, sf_dir).select("doc_id", "text", "lang").write.parquet(f"{folder}/in")
    stream = ingest.documents(spark, f"{folder}/in", "doc_id long, text string, lang string")
    ingest.process(stream, lambda df: df.select("doc_id", "lang", tx.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens")), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    rows = spark.read.schema("doc_id long, lang string, tokens long").parquet(f"{folder}/out")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def nodes_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node at one path of every document that has it."""
    return structure.node_by_path(ps.walked(spark, sf_dir), "1.1").select("document_id", "ord", "reference")


def unindexed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows without those of toxic documents."""
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("entry_id"))
    return registry.without(pm.index_rows(spark, sf_dir), gone, "entry_id").groupBy("model", "status").agg(F.count("*").alias("n"), F.sum("entry_id").alias("ids"))


_DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents WHERE doc_id IS NOT NULL)"
QUERIES = {
    "page_confidence": page_confidence,
    "meaningful_text": meaningful_text,
    "newest_results": newest_results,
    "metadata_patches": metadata_patches,
    "question_lines": question_lines,
    "audit_events": audit_events,
    "report_rows": report_rows,
    "decoded_uploads": decoded_uploads,
    "streamed_documents": streamed_documents,
    "nodes_by_path": nodes_by_path,
    "unindexed_entries": unindexed_entries,
}
SQL = {
    "page_confidence": f"""WITH {ps._PLAIN}, l AS (SELECT *, ((document_id + line_no * 7) % 64) / 64.0::DOUBLE AS c FROM plain), p AS (SELECT document_id, page_number, avg(c) AS page, sum(c) AS total, count(*) AS n FROM l GROUP BY ALL)
SELECT document_id, round(avg(page), 4) AS page_confidence, round(min(page), 4) AS least_page, round(sum(total) / sum(n), 4) AS line_confidence FROM p GROUP BY document_id""",
    "meaningful_text": f"WITH {ps._PLAIN} SELECT document_id, sum(length(text))::BIGINT AS n_chars FROM plain GROUP BY document_id HAVING sum(length(text)) > 500",
    "newest_results": f"WITH {_DOCS} SELECT doc_id % 2 AS version_id, CASE WHEN doc_id % 3 = 0 THEN 'image' ELSE 'digital' END AS engine, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM d GROUP BY ALL",
    "metadata_patches": f"""WITH {_DOCS}, l AS (SELECT doc_id, any_value(CASE WHEN toxic = 1 THEN 'bad' ELSE quality::VARCHAR END) AS q FROM labels GROUP BY doc_id)
SELECT d.doc_id AS document_id, 'lang=' || CASE WHEN l.doc_id IS NULL THEN coalesce(lang, '-') ELSE 'xx' END || CASE WHEN l.doc_id IS NULL THEN '' ELSE ';quality=' || q END || ';source=' || coalesce(source, '-') AS metadata FROM d LEFT JOIN l USING (doc_id)""",
    "question_lines": "SELECT item_id::VARCHAR AS id, CASE WHEN item_id % 3 = 0 THEN 'lookup' ELSE 'summary' END AS category, sha256(text) AS query_sha256, item_id % 7 = 0 AS should_abstain, true AS open FROM benchmark",
    "audit_events": f"WITH {_DOCS}, e AS (SELECT doc_id, 'create' AS event, 'INFO' AS severity FROM d UNION ALL SELECT doc_id, 'read', 'WARN' FROM d WHERE doc_id % 4 = 0) SELECT (DATE '2024-01-01' + ((doc_id * 3600 % (86400 * 20)) // 86400)::INTEGER)::DATE AS day, event, severity, count(*) AS n FROM e GROUP BY ALL",
    "report_rows": f"WITH {_DOCS}, r AS (SELECT source AS component, count(*)::DOUBLE AS documents, sum(length(text))::DOUBLE AS characters FROM d GROUP BY ALL) SELECT component, 'documents' AS metric, documents AS value FROM r UNION ALL SELECT component, 'characters', characters FROM r",
    "decoded_uploads": "SELECT page_id, sha256(html) AS sha256, strlen(html)::INTEGER AS n_bytes FROM pages",
    "streamed_documents": f"WITH {_DOCS} SELECT lang, count(*) AS n, sum(CASE WHEN text = '' THEN 0 ELSE greatest(1, length(text) // 4) END)::BIGINT AS tokens FROM d GROUP BY lang",
    "nodes_by_path": f"WITH {ps._WALKED} SELECT document_id, ord, reference FROM walked WHERE path = '1.1'",
    "unindexed_entries": f"WITH one AS ({pm._ROWS}) SELECT model, status, count(*) AS n, sum(entry_id)::BIGINT AS ids FROM one WHERE entry_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY ALL",
}
