"""Queries of the administrative folds and compositions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text as tx
from tesserae.operators import admin, retrieval
from tesserae.plans import citation as pc
from tesserae.plans import registry as pg
from tesserae.plans import retrieval as pr
from tesserae.plans import structure as ps
from tesserae.plans.common import DOCUMENTS, collapse_sql, documents, table


def search_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, w = pr.semantic_pool(spark, sf_dir), pr.keyword_pool(spark, sf_dir)
    parts = [admin.search(x, s, w, 5).withColumn("strategy", F.lit(x)) for x in ("KEYWORD", "SEMANTIC")]
    return parts[0].unionByName(parts[1])


def evidence_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.rerank(pr.evidence(spark, sf_dir))
    return admin.evidence_prompt(rows.withColumn("label", F.col("reference"))).select("query_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("long").alias("n_chars"))


def answer_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = pc.answers(spark, sf_dir).select("answer_id", F.when(F.col("answer_id") % 5 == 0, "NO_EVIDENCE").otherwise("SUCCESS").alias("status"))
    return admin.validated(answers, pc.claims(spark, sf_dir), pc.links(spark, sf_dir))


def tree_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.descendants(ps.sized(spark, sf_dir)).where("ord > 0")


def source_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    contents = documents(spark, sf_dir).select("document_id", F.encode("text", "UTF-8").alias("content"))
    return admin.source_view(ps.plain_lines(spark, sf_dir), contents).select("document_id", "page_number", F.md5("text").alias("text_md5"), F.md5("content_base64").alias("content_md5"))


def _vault_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    action = F.when(F.col("o_orderstatus") == "F", "ARCHIVE").when(F.col("o_orderstatus") == "O", "RESTORE").otherwise("RENAME")
    return o.select((F.col("o_custkey") % 200).alias("vault_id"), F.col("o_orderkey").alias("seq"), action.alias("action"), F.when(action == "RENAME", F.concat(F.lit("vault "), F.col("o_orderkey").cast("string"))).alias("name"))


def vault_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.vault_states(_vault_events(spark, sf_dir))


def member_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    action = F.when(F.col("l_returnflag") == "R", "REMOVE").when(F.col("l_returnflag") == "A", "CHANGE").otherwise("ADD")
    events = li.select((F.col("l_partkey") % 50).cast("long").alias("vault_id"), F.col("l_suppkey").cast("long").alias("user_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("base"), F.col("l_extendedprice"), action.alias("action"), F.when(F.col("l_quantity") > 25, "MANAGER").otherwise("VIEWER").alias("role"))
    return admin.member_roles(events.withColumn("seq", F.struct("base", "l_extendedprice", "action", "role")))


def job_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = pg.job_lifecycle(spark, sf_dir).select("job_id", "document_id", "last_status")
    states = pg.state_events(spark, sf_dir).groupBy("document_id").agg(F.max_by("state", "seq").alias("state"))
    return admin.job_list(jobs, documents(spark, sf_dir), states).select("job_id", "document_id", "last_status", "state", "title")


def upload_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = pg.state_events(spark, sf_dir).groupBy("document_id").agg(F.max_by("state", "seq").alias("state"))
    return admin.upload_status(documents(spark, sf_dir), states, pg.job_lifecycle(spark, sf_dir))


def member_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as member events of the customers' vaults."""
    o = table(spark, sf_dir, "orders")
    action = F.when(F.col("o_orderstatus") == "F", "REMOVE").when(F.col("o_orderstatus") == "O", "ADD").otherwise("CHANGE")
    events = o.select((F.col("o_custkey") % 70).alias("vault_id"), (F.col("o_custkey") % 11).alias("user_id"), F.col("o_orderkey").alias("seq"), action.alias("action"), F.lit("VIEWER").alias("role"))
    vaults = spark.range(0, 64).select(F.col("id").alias("vault_id"), (F.col("id") % 11).alias("owner"))
    return admin.member_errors(events, vaults).groupBy("vault_id", "error").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def tagged_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.with_tag(pg.tags(spark, sf_dir), "ECONOMY").select("p_partkey", F.size("tags").cast("long").alias("n_tags"))


def no_evidence_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that say so; every seventh is given the phrase."""
    a = pc.answers(spark, sf_dir)
    content = F.when(F.col("answer_id") % 7 == 0, F.concat(F.lit("  The  evidence\nis insufficient. "), F.col("content"))).otherwise(F.col("content"))
    return a.select("answer_id", tx.reports_no_evidence(content).alias("no_evidence"))


def stale_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), F.lit("ACTIVE").alias("status"), "label")
    rows = admin.with_document_status(admin.marked_stale(v, F.col("label") % 4 == 0), pg.registered(spark, sf_dir))
    return rows.groupBy("status", "document_status").agg(F.count("*").alias("n"))


def rollback_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' plans with flags from their numbers: all of six needed."""
    s = table(spark, sf_dir, "supplier")
    flags = {f"f{i}": (F.col("s_suppkey") * 7 + i) % (i + 3) != 0 for i in range(6)}
    return admin.flags_ready(s.select(F.col("s_suppkey").cast("long").alias("release_id"), *[v.alias(k) for k, v in flags.items()]), list(flags)).select("release_id", "ready")


def highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", admin.highlighted("text", ["the", "ing"]).alias("text"))


_INSUFFICIENT = " OR ".join(f"regexp_matches(o, '{p}')" for p in tx.INSUFFICIENT)
QUERIES = {
    "search_strategies": search_strategies,
    "evidence_prompt": evidence_prompt,
    "answer_validation": answer_validation,
    "tree_descendants": tree_descendants,
    "source_view": source_view,
    "vault_states": vault_states,
    "member_roles": member_roles,
    "job_list": job_list,
    "upload_status": upload_status,
    "member_errors": member_errors,
    "tagged_parts": tagged_parts,
    "no_evidence_answers": no_evidence_answers,
    "stale_entries": stale_entries,
    "rollback_plans": rollback_plans,
    "highlighted": highlighted,
}
SQL = {
    "search_strategies": f"""WITH {pr._FUSED} SELECT query_id, entry_id, w AS score, w_rank AS rank, 'KEYWORD' AS strategy FROM w WHERE w_rank <= 5 UNION ALL SELECT query_id, entry_id, s, s_rank, 'SEMANTIC' FROM s WHERE s_rank <= 5""",
    "evidence_prompt": f"""WITH {pr._RERANKED}, p AS (SELECT query_id, string_agg('[Nguồn ' || rank || ']' || chr(10) || 'Tài liệu: ' || coalesce(title, 'Document ' || evidence_id) || chr(10) || 'Vị trí: ' || coalesce(reference, 'Source ' || rank) || chr(10) || 'Nội dung:' || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS prompt FROM reranked GROUP BY query_id)
SELECT query_id, md5(prompt) AS prompt_md5, length(prompt)::BIGINT AS n_chars FROM p""",
    "answer_validation": f"""WITH {pc._LINKS}, u AS (SELECT answer_id, count(*) AS n FROM claims c WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.answer_id = c.answer_id AND l.sentence_index = c.sentence_index AND l.claim_no = c.claim_no) GROUP BY answer_id)
SELECT a.answer_id, CASE WHEN a.answer_id % 5 = 0 THEN 'NO_EVIDENCE' WHEN n > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status, coalesce(n, 0) AS n_unsupported, n || ' claim(s) could not be supported by evidence.' AS limitation FROM answers a LEFT JOIN u USING (answer_id)""",
    "tree_descendants": f"WITH {ps._SIZED} SELECT a.document_id, a.top AS ord, a.ord AS descendant FROM above a WHERE a.top > 0 AND a.ord != a.top",
    "source_view": f"WITH {ps._PLAIN}, pages_of AS (SELECT document_id, page_number, string_agg(text, chr(10) ORDER BY line_no) AS text FROM plain GROUP BY ALL) SELECT p.document_id, page_number, md5(p.text) AS text_md5, md5(base64(encode(d.text))) AS content_md5 FROM pages_of p JOIN docs d USING (document_id)",
    "vault_states": """WITH e AS (SELECT o_custkey % 200 AS vault_id, o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN 'ARCHIVE' WHEN 'O' THEN 'RESTORE' ELSE 'RENAME' END AS action FROM orders),
s AS (SELECT *, CASE action WHEN 'ARCHIVE' THEN 'ARCHIVED' WHEN 'RESTORE' THEN 'ACTIVE' END AS st FROM e),
c AS (SELECT *, arg_max(st, seq) FILTER (st IS NOT NULL) OVER (PARTITION BY vault_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
SELECT vault_id, arg_max(st, seq) FILTER (st IS NOT NULL) AS status, 'vault ' || max(seq) FILTER (action = 'RENAME') AS name, count(*) FILTER (st IS NOT NULL AND before IS NOT DISTINCT FROM st) AS n_errors FROM c GROUP BY vault_id""",
    "member_roles": """WITH e AS (SELECT (l_partkey % 50)::BIGINT AS vault_id, l_suppkey::BIGINT AS user_id, l_orderkey * 10 + l_linenumber AS base, l_extendedprice AS price, CASE l_returnflag WHEN 'R' THEN 'REMOVE' WHEN 'A' THEN 'CHANGE' ELSE 'ADD' END AS action, CASE WHEN l_quantity > 25 THEN 'MANAGER' ELSE 'VIEWER' END AS role FROM lineitem)
SELECT vault_id, user_id, role FROM (SELECT *, row_number() OVER (PARTITION BY vault_id, user_id ORDER BY base DESC, price DESC, action DESC, role DESC) AS r FROM e) WHERE r = 1 AND action != 'REMOVE'""",
    "job_list": f"WITH {pg._JOBS}, {DOCUMENTS}, {pg._EVENTS}, st AS (SELECT document_id, arg_max(state, seq) AS state FROM states GROUP BY document_id) SELECT job_id, document_id, last_status, state, title FROM jobs JOIN docs USING (document_id) JOIN st USING (document_id)",
    "upload_status": f"WITH {pg._JOBS}, {DOCUMENTS}, {pg._EVENTS}, st AS (SELECT document_id, arg_max(state, seq) AS state FROM states GROUP BY document_id), j AS (SELECT document_id, arg_max(last_status, {{'c': created_at, 'j': job_id}}) AS last_status FROM jobs GROUP BY document_id) SELECT document_id, state, last_status FROM docs LEFT JOIN st USING (document_id) LEFT JOIN j USING (document_id)",
    "member_errors": """WITH e AS (SELECT o_custkey % 70 AS vault_id, o_custkey % 11 AS user_id, o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN 'REMOVE' WHEN 'O' THEN 'ADD' ELSE 'CHANGE' END AS action FROM orders),
b AS (SELECT *, lag(action) OVER (PARTITION BY vault_id, user_id ORDER BY seq) AS before FROM e),
t AS (SELECT *, CASE WHEN vault_id >= 64 THEN 'unknown_vault' WHEN user_id = vault_id % 11 AND action != 'ADD' THEN 'owner_protected' WHEN action = 'ADD' AND (user_id = vault_id % 11 OR coalesce(before != 'REMOVE', false)) THEN 'already_member' WHEN action != 'ADD' AND NOT coalesce(before != 'REMOVE', false) THEN 'not_a_member' END AS error FROM b)
SELECT vault_id, error, count(*) AS n, min(seq) AS first_seq FROM t WHERE error IS NOT NULL GROUP BY ALL""",
    "tagged_parts": f"WITH {pg._TAGS} SELECT p_partkey, count(*) AS n_tags FROM tags GROUP BY p_partkey HAVING bool_or(tag = 'ECONOMY')",
    "no_evidence_answers": f"WITH {pc._ANSWERS}, o AS (SELECT answer_id, substring({collapse_sql('lower(x)')}, 1, 700) AS o FROM (SELECT answer_id, CASE WHEN answer_id % 7 = 0 THEN '  The  evidence' || chr(10) || 'is insufficient. ' ELSE '' END || content AS x FROM answers)) SELECT answer_id, {_INSUFFICIENT} AS no_evidence FROM o",
    "stale_entries": f"WITH {pg._REGISTERED} SELECT CASE WHEN label % 4 = 0 THEN 'STALE' ELSE 'ACTIVE' END AS status, r.status AS document_status, count(*) AS n FROM embeddings e JOIN registered r ON r.document_id = e.vec_id GROUP BY ALL",
    "rollback_plans": "SELECT s_suppkey::BIGINT AS release_id, " + " AND ".join(f"(s_suppkey * 7 + {i}) % {i + 3} != 0" for i in range(6)) + " AS ready FROM supplier",
    "highlighted": "SELECT item_id, regexp_replace(text, '(the|ing)', '<mark>\\1</mark>', 'gi') AS text FROM benchmark",
}
