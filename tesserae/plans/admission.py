"""Queries of registration and vaults' documents: documents are requests, sources are vaults, customers are users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import admission
from tesserae.plans import files as pf
from tesserae.plans import registry as pg
from tesserae.plans.common import table
from tesserae.sources import files

_USERS = 1500


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents ask to be registered by customers, some in a vault that there isn't; with targets of three kinds of edges."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    vault = F.when(i % 23 == 0, F.lit("nowhere")).otherwise(F.col("source"))
    some = lambda test, *ids: F.when(test, F.array(*ids)).otherwise(F.array().cast("array<bigint>"))
    return d.select(
        i.alias("document_id"), (i % _USERS + 1).alias("user_id"), vault.alias("vault_id"), F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)).alias("title"), F.sha2(F.encode("text", "UTF-8"), 256).alias("checksum"),
        some(i % 3 == 0, i - 1).alias("supersedes"), some(i % 4 == 0, i - 1, i - 2, i - 1).alias("amends"), some(i % 5 == 0, F.expr("doc_id div 2")).alias("references"),
    )


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.judged(_requests(spark, sf_dir), pg.vaults(spark, sf_dir), pg.authorized_scope(spark, sf_dir)).where("error IS NULL")


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request: refused with a category and its status, or registered with how many have the same content."""
    judged = admission.judged(_requests(spark, sf_dir), pg.vaults(spark, sf_dir), pg.authorized_scope(spark, sf_dir))
    done = admission.registered(judged.where("error IS NULL")).select("document_id", "state", "n_same")
    category = F.when(F.col("error").startswith("vault"), "validation").when(F.col("error").isNotNull(), "authorization")
    return judged.join(done, "document_id", "left").select("document_id", "vault_id", "error", admission.category_status(category).alias("status"), "state", "n_same")


def registration_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.registration_edges(_accepted(spark, sf_dir))


_REQUESTS = f"""{pg._UPLOAD},
requests AS (SELECT doc_id AS document_id, doc_id % {_USERS} + 1 AS user_id, CASE WHEN doc_id % 23 = 0 THEN 'nowhere' ELSE source END AS vault_id, sha256(text) AS checksum FROM documents WHERE doc_id IS NOT NULL),
judged AS (SELECT r.*, CASE WHEN r.vault_id NOT IN (SELECT vault_id FROM vaults WHERE vault_id IS NOT NULL) THEN 'vault does not exist' WHEN s.user_id IS NULL THEN 'not authorized to create documents in the vault' END AS error FROM requests r LEFT JOIN scopes s ON s.user_id = r.user_id AND s.vault_id = r.vault_id)"""
_REGISTRATIONS = f"""WITH {_REQUESTS}, same AS (SELECT document_id, CASE WHEN checksum IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY checksum) - 1 END AS n_same FROM judged WHERE error IS NULL)
SELECT document_id, vault_id, error, CASE WHEN error IS NULL THEN 200 WHEN starts_with(error, 'vault') THEN 400 ELSE 403 END AS status, CASE WHEN error IS NULL THEN 'UPLOADED' END AS state, n_same FROM judged LEFT JOIN same USING (document_id)"""
_EDGES = f"""WITH {_REQUESTS}, ok AS (SELECT document_id AS d FROM judged WHERE error IS NULL),
e AS (SELECT d AS source_id, d - 1 AS target_id, 'SUPERSEDES' AS kind FROM ok WHERE d % 3 = 0 UNION SELECT d, unnest([d - 1, d - 2]), 'AMENDS' FROM ok WHERE d % 4 = 0 UNION SELECT d, d // 2, 'REFERENCES' FROM ok WHERE d % 5 = 0)
SELECT * FROM e"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are assigned to their source's vault and to others, taken out, assigned again, also where they are already."""
    i, k = F.col("doc_id"), F.col("k")
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(i, "source", F.explode(F.array(*map(F.lit, range(1, 6)))).alias("k"))
    vault = F.when((i + k) % 3 == 0, F.concat(F.lit("src"), (i % 25).cast("string"))).otherwise(F.col("source"))
    return d.select((i * 5 + k).alias("seq"), vault.alias("vault_id"), i.alias("document_id"), F.when((i * k) % 4 == 3, "UNASSIGN").otherwise("ASSIGN").alias("action"))


def vault_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each vault, with when they came."""
    return admission.vault_edges(_events(spark, sf_dir), pg.vaults(spark, sf_dir))


def vault_document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = pg.vaults(spark, sf_dir)
    return admission.vault_counts(admission.vault_edges(_events(spark, sf_dir), v), v)


_HELD = f"""WITH {pg._VAULTS}, k AS (SELECT doc_id, source, unnest(range(1, 6)) AS k FROM documents WHERE doc_id IS NOT NULL),
events AS (SELECT doc_id * 5 + k AS seq, CASE WHEN (doc_id + k) % 3 = 0 THEN 'src' || (doc_id % 25) ELSE source END AS vault_id, doc_id AS document_id, (doc_id * k) % 4 = 3 AS gone FROM k),
known AS (SELECT * FROM events WHERE vault_id IN (SELECT vault_id FROM vaults)),
last AS (SELECT vault_id, document_id, max(seq) FILTER (gone) AS seq FROM known GROUP BY ALL),
held AS (SELECT vault_id, document_id, min(known.seq) AS assigned_seq FROM known JOIN last USING (vault_id, document_id) WHERE NOT gone AND (last.seq IS NULL OR known.seq > last.seq) GROUP BY ALL)"""


def package_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upload gate over good and broken packages, with declared media types: what is accepted, or why not."""
    key = F.col("key").cast("long")
    mime = F.when(key % 9 == 0, "image/png").when(key % 9 == 1, files.MIME_DOCX).when(key % 9 == 2, files.MIME_PDF).when(key % 9 == 3, "application/octet-stream")
    rows = pf.packages(spark, sf_dir).withColumnRenamed("name", "filename").withColumn("filename", F.when(key % 9 == 1, F.concat(F.col("key"), F.lit(".bin"))).otherwise(F.col("filename"))).withColumn("mime_type", mime)
    return files.upload_gate(rows).select(key.alias("shelf"), "accepted", "reject_reason", "stored_name")


#: The gate's rules over what was done to each package: its media type first, then its content.
_GATE_SQL = f"""WITH {pf._SHELVES}, s AS (SELECT shelf, shelf % {pf.KINDS} AS k, shelf % 9 AS m, body FROM shelves),
j AS (SELECT *, CASE WHEN m = 0 THEN 'future type' WHEN m = 2 THEN 'not a PDF' WHEN k = 3 THEN 'not a DOCX' WHEN k = 0 THEN 'broken DOCX package' WHEN k = 1 THEN 'DOCX without main part' WHEN k = 2 THEN 'DOCX with invalid XML' WHEN k = 4 OR body = '' THEN 'DOCX without text' END AS reason FROM s)
SELECT shelf, reason IS NULL AS accepted, reason AS reject_reason, CASE WHEN m = 1 THEN shelf || '_bin' ELSE 'shelf_' || shelf || '_docx' END AS stored_name FROM j"""

QUERIES = {"registrations": registrations, "registration_edges": registration_edges, "vault_documents": vault_documents, "vault_document_counts": vault_document_counts, "package_gate": package_gate}
SQL = {
    "registrations": _REGISTRATIONS,
    "registration_edges": _EDGES,
    "vault_documents": f"{_HELD} SELECT * FROM held",
    "vault_document_counts": f"{_HELD} SELECT vault_id, count(document_id) AS document_count FROM vaults LEFT JOIN held USING (vault_id) GROUP BY ALL",
    "package_gate": _GATE_SQL,
}
