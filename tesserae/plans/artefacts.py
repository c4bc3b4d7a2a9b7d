"""Queries over artefact tables: lineitems stand for chunks, their vectors and index rows, orders for versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import artefacts, evaluation
from tesserae.plans import citation as pc
from tesserae.plans import registry as pg
from tesserae.plans.common import DOCUMENTS, documents, table

MODEL, MODEL_VERSION, DIMENSION = "m1", "v2", 64


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer is a document, its orders are versions."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "ARCHIVED").otherwise("ACTIVE")
    return o.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("price"))


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lineitems with their chunk_id, without the document that their order names."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").alias("n"), "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("tokens"))
    return rows.withColumn("chunk_id", F.concat_ws("-", F.col("version_id").cast("string"), F.col("n").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, sf_dir).join(versions(spark, sf_dir).select("document_id", "version_id"), "version_id")


def vectors(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """of: rows like those of chunks, where the document isn't asked for."""
    c, p = chunks(spark, sf_dir) if of is None else of, F.col("l_partkey")
    return c.where(p % 40 != 0).select(
        *[x for x in ("document_id", "version_id") if x in c.columns], "chunk_id", F.concat(F.lit("e"), F.col("chunk_id")).alias("embedding_id"), F.when(p % 37 == 0, "STALE").otherwise("ACTIVE").alias("status"),
        F.when(p % 41 == 0, "m0").otherwise(MODEL).alias("model"), F.lit(MODEL_VERSION).alias("model_version"), F.when(p % 43 == 0, 32).otherwise(DIMENSION).alias("dimension"), "l_partkey", "l_suppkey",
    )


def entries(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    v, s = vectors(spark, sf_dir, of), F.col("l_suppkey")
    return v.where(s % 31 != 0).select(
        *[c for c in v.columns if c not in ("l_partkey", "l_suppkey")], F.concat(F.lit("i"), F.col("chunk_id")).alias("entry_id"), F.concat(F.lit("src"), (s % 20).cast("string")).alias("vault_id"),
        F.when(s % 3 == 0, "ARTICLE").when(s % 3 == 1, "CLAUSE").otherwise("POINT").alias("chunk_type"), F.when(s % 2 == 0, "vi").otherwise("en").alias("language"),
    )


_VERSIONS = "versions AS (SELECT o_custkey AS document_id, o_orderkey AS version_id, CASE WHEN o_orderstatus = 'F' THEN 'ARCHIVED' ELSE 'ACTIVE' END AS status, o_orderdate AS created_at, o_totalprice AS price FROM orders)"
_CHUNKS = f"""{_VERSIONS},
chunks AS (SELECT o_custkey AS document_id, o_orderkey AS version_id, l_linenumber AS n, l_partkey, l_suppkey, l_quantity::BIGINT AS tokens, o_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS chunk_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
_ENTRIES = f"""{_CHUNKS},
vectors AS (SELECT document_id, version_id, chunk_id, 'e' || chunk_id AS embedding_id, CASE WHEN l_partkey % 37 = 0 THEN 'STALE' ELSE 'ACTIVE' END AS status, CASE WHEN l_partkey % 41 = 0 THEN 'm0' ELSE '{MODEL}' END AS model, CASE WHEN l_partkey % 43 = 0 THEN 32 ELSE {DIMENSION} END AS dimension, l_suppkey FROM chunks WHERE l_partkey % 40 != 0),
entries AS (SELECT *, 'i' || chunk_id AS entry_id, 'src' || (l_suppkey % 20) AS vault_id, CASE l_suppkey % 3 WHEN 0 THEN 'ARTICLE' WHEN 1 THEN 'CLAUSE' ELSE 'POINT' END AS chunk_type, CASE WHEN l_suppkey % 2 = 0 THEN 'vi' ELSE 'en' END AS language FROM vectors WHERE l_suppkey % 31 != 0)"""


def index_search_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a search with all filters may see, by vault."""
    kept = artefacts.searchable(entries(spark, sf_dir), DIMENSION, vault_id=["src1", "src4", "src6", "src12"], chunk_type=["ARTICLE", "CLAUSE"], model=MODEL, model_version=MODEL_VERSION, language="vi")
    return kept.groupBy("vault_id", "chunk_type").agg(F.count("*").alias("n"), F.min("entry_id").alias("first_entry"))


def chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by what they lack. A chunk_id names its order, so vectors and entries of lines without one meet no chunk: only the chunks are joined with orders."""
    lines = listed(spark, sf_dir)
    found = artefacts.by_chunk(chunks(spark, sf_dir), vectors(spark, sf_dir, lines), entries(spark, sf_dir, lines))
    return found.groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.count("embedding_id").alias("n_vectors"), F.count("entry_id").alias("n_entries"))


def collection_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artefacts.collection_totals(chunks(spark, sf_dir))


def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest artefact of each document."""
    return artefacts.latest(versions(spark, sf_dir), ["document_id"], "created_at", "version_id").select("document_id", "version_id", "status")


def _problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, c = versions(spark, sf_dir), chunks(spark, sf_dir)
    declared = c.groupBy("document_id", "version_id").agg(F.count("*").alias("total")).withColumn("n_declared", F.col("total") + F.when(F.col("version_id") % 17 == 0, 1).otherwise(0)).drop("total")
    newest = c.join(declared, artefacts.KEY).withColumns({"collection_id": F.lit("b"), "created_at": F.lit(2)})
    # Every fifth version has an older collection that lists a chunk too few, and every seventh of these a newer one that does.
    other = newest.where("version_id % 5 = 0 AND n > 1").withColumns({"collection_id": F.lit("a"), "created_at": F.when(F.col("version_id") % 7 == 0, 3).otherwise(1)})
    collections = newest.unionByName(other)
    return artefacts.version_problems(v, v.where("version_id % 19 != 0"), v.where("version_id % 23 != 0"), collections, vectors(spark, sf_dir), entries(spark, sf_dir), MODEL, MODEL_VERSION, DIMENSION)


def version_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _problems(spark, sf_dir)


def restored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = artefacts.restored(versions(spark, sf_dir), _problems(spark, sf_dir))
    return out.groupBy("status", "restored").agg(F.count("*").alias("n"), F.count("reason").alias("n_refused"))


def requeued_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = pg.state_events(spark, sf_dir).groupBy("document_id").agg(F.max_by("state", "seq").alias("state"))
    return artefacts.requeued(states, pg.job_lifecycle(spark, sf_dir).select("document_id", "last_status"))


def vault_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders move documents (by customer) to vaults, or take them out."""
    o = table(spark, sf_dir, "orders")
    vault = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("src"), (F.col("o_orderkey") % 20).cast("string")))
    events = o.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("seq"), vault.alias("vault_id"))
    return artefacts.assigned(documents(spark, sf_dir).select("document_id", "vault_id"), events)


def case_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers judged by component: retrieval, citation, generation, and all of them."""
    scored = pc.citation_metrics(spark, sf_dir)
    said = pc.answers(spark, sf_dir).select("answer_id", F.length("content").alias("n_chars"), (F.col("answer_id") % 6 == 0).alias("abstained"), (F.col("answer_id") % 9 == 0).alias("should_abstain"))
    return evaluation.case_verdicts(scored.join(said, "answer_id"))


def component_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.component_report(case_verdicts(spark, sf_dir))


_READY = f"""{_ENTRIES},
declared AS (SELECT document_id, version_id, count(*) + CASE WHEN version_id % 17 = 0 THEN 1 ELSE 0 END AS n, count(*) FILTER (NOT short OR n > 1) AS listed, count(DISTINCT chunk_id) FILTER (NOT short OR n > 1) AS ids
  FROM (SELECT *, version_id % 35 = 0 AND bool_or(n > 1) OVER (PARTITION BY version_id) AS short FROM chunks) GROUP BY document_id, version_id),
good_vectors AS (SELECT version_id, count(*) AS n, count(DISTINCT chunk_id) AS c FROM vectors WHERE status = 'ACTIVE' AND model = '{MODEL}' AND dimension = {DIMENSION} GROUP BY ALL),
good_entries AS (SELECT version_id, count(*) AS n, count(DISTINCT chunk_id) AS c, count(DISTINCT embedding_id) AS e FROM entries WHERE status = 'ACTIVE' AND model = '{MODEL}' AND dimension = {DIMENSION} GROUP BY ALL),
told AS (SELECT v.document_id, v.version_id, v.status, concat_ws('; ', CASE WHEN v.version_id % 19 = 0 THEN 'no extraction result' END, CASE WHEN v.version_id % 23 = 0 THEN 'no tree' END, CASE WHEN d.n IS NULL THEN 'no chunks' END, CASE WHEN d.listed != d.n OR d.ids != d.n THEN 'inconsistent chunks' END,
 CASE WHEN d.n IS NULL OR coalesce(g.n, 0) != d.n OR g.c != d.n THEN 'vectors don''t cover the chunks' END, CASE WHEN d.n IS NULL OR coalesce(x.n, 0) != d.n OR x.c != d.n OR x.e != d.n THEN 'index doesn''t cover the vectors' END) AS problems
 FROM versions v LEFT JOIN declared d USING (version_id) LEFT JOIN good_vectors g USING (version_id) LEFT JOIN good_entries x USING (version_id))"""
QUERIES = {
    "index_search_filter": index_search_filter,
    "chunk_coverage": chunk_coverage,
    "collection_totals": collection_totals,
    "latest_versions": latest_versions,
    "version_readiness": version_readiness,
    "restored_documents": restored_documents,
    "requeued_documents": requeued_documents,
    "vault_assignments": vault_assignments,
    "case_verdicts": case_verdicts,
    "component_report": component_report,
}
_VERDICTS = f"""{pc._LINKS}, c AS (SELECT answer_id, count(*) AS generated, count(*) % 3 AS expected, least(count(*) FILTER (EXISTS (SELECT 1 FROM links l WHERE l.answer_id = claims.answer_id AND l.sentence_index = claims.sentence_index AND l.claim_no = claims.claim_no)), count(*) % 3) AS correct FROM claims GROUP BY answer_id),
v AS (SELECT answer_id, CASE WHEN expected = 0 THEN true ELSE correct::DOUBLE / expected >= 0.5 END AS retrieval, CASE WHEN generated = 0 THEN true ELSE correct::DOUBLE / generated >= 0.5 END AS citation, CASE WHEN answer_id % 9 = 0 THEN answer_id % 6 = 0 ELSE answer_id % 6 != 0 AND length(content) > 0 END AS generation FROM c JOIN answers USING (answer_id)),
verdicts AS (SELECT *, retrieval AND citation AND generation AS pipeline, CASE WHEN NOT retrieval THEN 'RETRIEVAL' WHEN NOT citation THEN 'CITATION' WHEN NOT generation THEN 'GENERATION' END AS failure FROM v)"""
SQL = {
    "index_search_filter": f"WITH {_ENTRIES} SELECT vault_id, chunk_type, count(*) AS n, min(entry_id) AS first_entry FROM entries WHERE status = 'ACTIVE' AND dimension = {DIMENSION} AND model = '{MODEL}' AND language = 'vi' AND vault_id IN ('src1', 'src4', 'src6', 'src12') AND chunk_type IN ('ARTICLE', 'CLAUSE') GROUP BY ALL",
    "chunk_coverage": f"WITH {_ENTRIES} SELECT c.document_id, count(*) AS n_chunks, count(v.embedding_id) AS n_vectors, count(i.entry_id) AS n_entries FROM chunks c LEFT JOIN (SELECT * FROM vectors WHERE status = 'ACTIVE') v USING (chunk_id) LEFT JOIN (SELECT * FROM entries WHERE status = 'ACTIVE') i ON i.embedding_id = v.embedding_id GROUP BY c.document_id",
    "collection_totals": f"WITH {_CHUNKS} SELECT document_id, version_id, count(*) AS n_chunks, sum(tokens)::BIGINT AS n_tokens FROM chunks GROUP BY ALL",
    "latest_versions": f"WITH {_VERSIONS} SELECT document_id, version_id, status FROM versions QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, version_id DESC) = 1",
    "version_readiness": f"WITH {_READY} SELECT document_id, version_id, problems, problems = '' AS ready FROM told",
    "restored_documents": f"WITH {_READY}, r AS (SELECT CASE WHEN status = 'ARCHIVED' AND problems = '' THEN 'ACTIVE' ELSE status END AS status, status = 'ARCHIVED' AND problems = '' AS restored FROM told) SELECT status, restored, count(*) AS n, count(*) FILTER (NOT restored) AS n_refused FROM r GROUP BY ALL",
    "requeued_documents": f"WITH {pg._JOBS}, {pg._EVENTS}, st AS (SELECT document_id, arg_max(state, seq) AS state FROM states GROUP BY document_id) SELECT document_id, 'UPLOADED' AS state FROM st WHERE state = 'FAILED' AND document_id NOT IN (SELECT document_id FROM jobs WHERE last_status IN ('PENDING', 'RUNNING'))",
    "vault_assignments": f"WITH {DOCUMENTS}, last_one AS (SELECT o_custkey AS document_id, max(o_orderkey) AS k FROM orders GROUP BY ALL) SELECT d.document_id, CASE WHEN k IS NULL THEN vault_id WHEN k % 5 != 0 THEN 'src' || (k % 20) END AS vault_id FROM docs d LEFT JOIN last_one l USING (document_id)",
    "case_verdicts": f"WITH {_VERDICTS} SELECT answer_id, retrieval, citation, generation, pipeline, failure FROM verdicts",
    "component_report": f"WITH {_VERDICTS}, p AS (UNPIVOT (SELECT answer_id, retrieval, citation, generation, pipeline FROM verdicts) ON retrieval, citation, generation, pipeline INTO NAME component VALUE passed) SELECT component, count(*) AS n_cases, count(*) FILTER (passed) AS n_passed, round(count(*) FILTER (passed)::DOUBLE / count(*), 6) AS pass_rate FROM p GROUP BY component",
}
