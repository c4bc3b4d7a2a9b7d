"""Registry, access, source and lifecycle queries over stand-ins made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import text as tx
from tesserae.operators import lifecycle, registry
from tesserae.plans import structure as ps
from tesserae.plans.common import documents, table
from tesserae.sources import files
from tesserae.sources.shared import fresh


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a status: archived where labelled toxic, stale where of low quality, else active."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), "quality", "toxic")
    status = F.when(F.col("toxic") == 1, "ARCHIVED").when(F.col("quality") == 0, "STALE").otherwise("ACTIVE")
    return documents(spark, sf_dir).join(labels, "document_id", "left").select("document_id", "title", "vault_id", "language", status.alias("status"))


_REGISTERED = "registered AS (SELECT d.doc_id AS document_id, split_part(coalesce(text, ''), chr(10), 1) AS title, source AS vault_id, lang AS language, CASE WHEN toxic = 1 THEN 'ARCHIVED' WHEN quality = 0 THEN 'STALE' ELSE 'ACTIVE' END AS status FROM documents d LEFT JOIN labels l USING (doc_id))"


def registry_filter_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = registry.filtered(registered(spark, sf_dir), vault_id="src3", status="ACTIVE")
    return registry.page(rows, [F.desc("document_id")], 5, 20).select("document_id", "language", "total", "has_more")


PAGE, RANGES = 25, 16


def registry_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of all documents by title (newest id first): by number from ranges, and the second one by the first one's last row."""
    rows = registered(spark, sf_dir).select("document_id", "title", "vault_id", "status")
    path, order = fresh(spark, "pages"), [F.asc("title"), F.desc("document_id")]
    registry.write_pages(rows, order, path, RANGES)
    total = spark.read.parquet(f"{path}/ranges").agg(F.sum("n")).first()[0] or 0
    numbered = [registry.read_page(spark, path, order, p * PAGE, PAGE).select(F.lit(f"page {p}").alias("page"), "document_id", "status", "total", "has_more") for p in (0, 1, total // PAGE // 2, total // PAGE)]
    seek = [("title", True), ("document_id", False)]
    last = registry.read_page(spark, path, order, PAGE - 1, 1).first()
    behind = registry.after(rows, seek, {"title": last["title"], "document_id": last["document_id"]} if last else {}, PAGE)
    numbered.append(behind.select(F.lit("behind").alias("page"), "document_id", "status", F.lit(total).cast("long").alias("total"), F.lit(total > 2 * PAGE).alias("has_more")))
    out = numbered[0]
    for df in numbered[1:]:
        out = out.unionByName(df)
    return out.distinct()


_PAGES_SQL = f"""WITH {_REGISTERED}, placed AS (SELECT document_id, status, row_number() OVER (ORDER BY title, document_id DESC) - 1 AS place, count(*) OVER () AS total FROM registered),
asked AS (SELECT DISTINCT p FROM (SELECT unnest([0, 1, total // {PAGE} // 2, total // {PAGE}]) AS p FROM (SELECT max(total) AS total FROM placed))),
pages AS (SELECT 'page ' || p AS page, p FROM asked UNION ALL SELECT 'behind', 1)
SELECT page, document_id, status, total, total > (p + 1) * {PAGE} AS has_more FROM placed JOIN pages ON place // {PAGE} = p"""


def tag_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 60 words of each vault's texts that hold a letter beyond a to z, in Vietnamese order: the options of a filter."""
    d = documents(spark, sf_dir)
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))), lambda w: w.rlike("[^a-z]"))
    return registry.first_options(d.select("vault_id", F.explode(words).alias("tag")), "vault_id", "tag", "vi", 60)


_OPTIONS_SQL = """WITH tags AS (SELECT DISTINCT source AS vault_id, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+'), lambda w: regexp_matches(w, '[^a-z]'))) AS tag FROM documents)
SELECT vault_id, tag, row_number() OVER (PARTITION BY vault_id ORDER BY tag COLLATE vi, tag)::INTEGER AS rank FROM tags QUALIFY rank <= 60"""


def registry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registered(spark, sf_dir).groupBy("vault_id", "status").agg(F.count("*").alias("n_documents"), F.count_distinct("language").alias("n_languages"))


def vaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vault for each source: every fifth is archived; owners are customers."""
    v = table(spark, sf_dir, "documents").select(F.col("source").alias("vault_id")).distinct()
    n = F.regexp_extract("vault_id", r"(\d+)$", 1).cast("int")
    return v.select("vault_id", n.alias("n"), F.when(n % 5 == 4, "ARCHIVED").otherwise("ACTIVE").alias("status"), (n + 1).cast("long").alias("owner"))


_VAULTS = "vaults AS (SELECT vault_id, n, CASE WHEN n % 5 = 4 THEN 'ARCHIVED' ELSE 'ACTIVE' END AS status, (n + 1)::BIGINT AS owner FROM (SELECT DISTINCT source AS vault_id, regexp_extract(source, '(\\d+)$', 1)::INTEGER AS n FROM documents))"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are members of the vault of their key modulo 20, with a role by segment."""
    c = table(spark, sf_dir, "customer")
    role = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "OWNER").when(F.col("c_mktsegment") == "BUILDING", "MANAGER").when(F.col("c_mktsegment") == "FURNITURE", "CONTRIBUTOR").otherwise("VIEWER")
    return c.select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("src"), (F.col("c_custkey") % 20).cast("string")).alias("vault_id"), role.alias("role"))


_MEMBERS = "members AS (SELECT c_custkey AS user_id, 'src' || (c_custkey % 20) AS vault_id, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'OWNER' WHEN 'BUILDING' THEN 'MANAGER' WHEN 'FURNITURE' THEN 'CONTRIBUTOR' ELSE 'VIEWER' END AS role FROM customer)"


def authorized_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.authorised_vaults(vaults(spark, sf_dir), members(spark, sf_dir), "UPLOAD")


_SCOPES = f"""{_VAULTS}, {_MEMBERS},
scopes AS (SELECT owner AS user_id, vault_id FROM vaults WHERE status = 'ACTIVE' UNION SELECT m.user_id, m.vault_id FROM members m JOIN vaults v USING (vault_id) WHERE v.status = 'ACTIVE' AND m.role IN {{roles}})"""
_UPLOAD = _SCOPES.format(roles=repr(tuple(r for r, p in registry.ROLE_PERMISSIONS.items() if "UPLOAD" in p)))
_READ = _SCOPES.format(roles=repr(tuple(registry.ROLE_PERMISSIONS)))


def scope_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    user, k = F.col("o_custkey") + 1, F.col("o_orderkey")
    requests = o.select(F.col("o_orderkey").alias("request_id"), user.alias("user_id"), F.when(k % 3 != 0, F.concat(F.lit("src"), (F.when(k % 2 == 0, user % 20).otherwise(k % 22)).cast("string"))).alias("vault_id"), F.when(k % 4 != 0, k % 1200).alias("document_id"))
    scopes = registry.authorised_vaults(vaults(spark, sf_dir), members(spark, sf_dir), "READ")
    return registry.scope_status(requests, scopes, documents(spark, sf_dir))


SCOPE_SQL = f"""WITH {_READ},
requests AS (SELECT o_orderkey AS request_id, o_custkey + 1 AS user_id, CASE WHEN o_orderkey % 3 != 0 THEN 'src' || (CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey + 1) % 20 ELSE o_orderkey % 22 END) END AS vault_id, CASE WHEN o_orderkey % 4 != 0 THEN o_orderkey % 1200 END AS document_id FROM orders)
SELECT request_id, r.user_id, r.vault_id, r.document_id, CASE
 WHEN r.vault_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM scopes s WHERE s.user_id = r.user_id AND s.vault_id = r.vault_id) THEN 'VAULT_FORBIDDEN'
 WHEN r.document_id IS NOT NULL AND d.doc_id IS NULL THEN 'DOCUMENT_NOT_FOUND'
 WHEN r.document_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM scopes s WHERE s.user_id = r.user_id AND s.vault_id = d.source) THEN 'DOCUMENT_FORBIDDEN'
 WHEN r.document_id IS NOT NULL AND r.vault_id IS NOT NULL AND d.source != r.vault_id THEN 'SCOPE_CONFLICT' ELSE 'OK' END AS status FROM requests r LEFT JOIN documents d ON d.doc_id = r.document_id"""


def relationships_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("source_id"), (F.col("l_partkey") % 97).cast("long").alias("target_id"), F.when(F.col("l_returnflag") == "A", "AMENDS").when(F.col("l_returnflag") == "R", "SUPERSEDES").otherwise("REFERENCES").alias("kind"))
    return registry.relationships(li)


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag list for each part, with other spellings and blanks."""
    p = table(spark, sf_dir, "part")
    raw = F.concat_ws(",", F.regexp_replace("p_type", " ", " , "), F.lower(F.col("p_type")), F.concat(F.lit("  "), F.col("p_brand"), F.lit("\n")), F.upper("p_brand"), F.lit(" "), "p_name")
    return p.select("p_partkey", tx.normalised_tags(raw).alias("tags"))


def tag_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags(spark, sf_dir).select("p_partkey", F.array_join("tags", "|").alias("tags"), F.size("tags").cast("long").alias("n_tags"))


def tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tags(spark, sf_dir).withColumn("tag", F.explode("tags")).groupBy("tag").agg(F.count("*").alias("n_parts"))
    return t.where(F.length("tag") > 4)


_TAGS = """raw AS (SELECT p_partkey, string_split(regexp_replace(concat_ws(',', regexp_replace(p_type, ' ', ' , ', 'g'), lower(p_type), '  ' || p_brand || chr(10), upper(p_brand), ' ', p_name), chr(10), ',', 'g'), ',') AS r FROM part),
clean AS (SELECT p_partkey, [regexp_replace(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') FOR t IN r] AS c FROM raw),
flat AS (SELECT p_partkey, unnest(c) AS tag, unnest(range(0, len(c))) AS k FROM clean),
kept AS (SELECT p_partkey, tag, k FROM flat WHERE tag != '' AND length(tag) <= 64 QUALIFY row_number() OVER (PARTITION BY p_partkey, lower(tag) ORDER BY k) = 1),
tags AS (SELECT p_partkey, tag, k FROM kept QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY k) <= 20)"""


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files made of pages: names and first bytes vary with the id."""
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id") % 7
    name = F.when(k == 0, F.concat(F.lit("~$"), F.col("page_id").cast("string"), F.lit(".docx"))).when(k == 1, F.concat(F.lit("a b.."), F.col("page_id").cast("string"), F.lit(".exe"))).when(k < 5, F.concat(F.lit("Báo cáo: "), F.col("page_id").cast("string"), F.lit(".PDF"))).otherwise(F.concat(F.lit("dir/"), F.col("page_id").cast("string"), F.lit(".docx")))
    body = F.when(k == 2, F.concat(F.lit("%PDF-1.7"), F.col("html"))).when(k == 4, F.lit("")).when(k == 5, F.concat(F.lit("PK\x03\x04"), F.col("html"))).otherwise(F.col("html"))
    return p.select(F.col("page_id").alias("document_id"), name.alias("filename"), F.encode(body, "UTF-8").alias("content"))


_FILES = """files AS (SELECT page_id AS document_id, CASE WHEN page_id % 7 = 0 THEN '~$' || page_id || '.docx' WHEN page_id % 7 = 1 THEN 'a b..' || page_id || '.exe' WHEN page_id % 7 < 5 THEN 'Báo cáo: ' || page_id || '.PDF' ELSE 'dir/' || page_id || '.docx' END AS filename,
CASE page_id % 7 WHEN 2 THEN '%PDF-1.7' || html WHEN 4 THEN '' WHEN 5 THEN 'PK' || chr(3) || chr(4) || html ELSE html END AS body FROM pages)"""


def upload_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.upload_gate(page_files(spark, sf_dir)).select("document_id", "accepted", "reject_reason", "checksum", "stored_name", "shard")


UPLOAD_SQL = f"""WITH {_FILES}, judged AS (SELECT *, lower(regexp_extract(filename, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM files),
reasons AS (SELECT *, CASE WHEN starts_with(filename, '~$') THEN 'lock file' WHEN ext NOT IN ('pdf', 'docx') THEN 'unsupported type' WHEN body = '' THEN 'empty file' WHEN ext = 'pdf' AND NOT starts_with(body, '%PDF') THEN 'not a PDF' WHEN ext = 'docx' AND NOT starts_with(body, 'PK' || chr(3) || chr(4)) THEN 'not a DOCX' WHEN ext = 'docx' THEN 'broken DOCX package' END AS reject_reason FROM judged)
SELECT document_id, reject_reason IS NULL AS accepted, reject_reason, sha256(body) AS checksum, regexp_replace(regexp_replace(translate(filename, '/\\:*?"<>|-', '__________'), '[._\\s]+', '_', 'g'), '^[._\\- ]+|[._\\- ]+$', '', 'g') AS stored_name, substring(sha256(body), 1, 2) AS shard FROM reasons"""


def checksum_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.checksum_duplicates(documents(spark, sf_dir).where("text is not null"), "text")


def html_text_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", files.html_text(F.col("html")).alias("text"))


def _html_sql() -> str:
    out = "regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->|<[^>]+>', ' ', 'g')"
    for entity, character in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{character}')"
    return f"SELECT page_id, regexp_replace(regexp_replace({out}, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS text FROM pages"


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    rows = v.select(F.when(F.col("label") < 8, "ACTIVE").otherwise("STALE").alias("status"), F.when(F.col("label") % 2 == 0, "bge").otherwise("nomic").alias("model"), F.size("embedding").alias("dimension"))
    return registry.index_stats(rows)


def outdated_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    rows = v.select("vec_id", F.when(F.col("label") < 8, "ACTIVE").otherwise("STALE").alias("status"), F.when(F.col("label") % 2 == 0, "bge").otherwise("nomic").alias("model"), (F.col("label") % 3).cast("string").alias("model_version"))
    return registry.outdated(rows, "bge", "0")


def ready_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their lines as chunks; some embeddings and index rows are missing."""
    docs = documents(spark, sf_dir)
    chunks = ps.plain_lines(spark, sf_dir).select("document_id", "line_no")
    d = F.col("document_id")
    embedded = chunks.where((d % 7 != 3) | (F.col("line_no") > 1)).select("document_id", "line_no", F.when((d % 13 == 5) & (F.col("line_no") == 2), 768).otherwise(1024).alias("dimension"))
    indexed = embedded.where(d % 5 != 1)
    return registry.ready_problems(docs, docs.where(d % 17 != 2), docs.where(d % 19 != 2), chunks, embedded, indexed)


READY_SQL = f"""WITH {ps._PLAIN}, emb AS (SELECT document_id, line_no, CASE WHEN document_id % 13 = 5 AND line_no = 2 THEN 768 ELSE 1024 END AS dimension FROM plain WHERE document_id % 7 != 3 OR line_no > 1),
c AS (SELECT document_id, count(*) AS n FROM plain GROUP BY ALL), e AS (SELECT document_id, count(*) AS n, count(DISTINCT dimension) AS k FROM emb GROUP BY ALL), x AS (SELECT document_id, count(*) AS n FROM emb WHERE document_id % 5 != 1 GROUP BY ALL),
r AS (SELECT d.document_id, coalesce(c.n, 0) AS n_chunks, coalesce(e.n, 0) AS n_embeddings, coalesce(x.n, 0) AS n_entries, coalesce(e.k, 0) AS k FROM docs d LEFT JOIN c USING (document_id) LEFT JOIN e USING (document_id) LEFT JOIN x USING (document_id)),
p AS (SELECT *, concat_ws('; ', CASE WHEN document_id % 17 = 2 THEN 'no source' END, CASE WHEN document_id % 19 = 2 THEN 'no tree' END, CASE WHEN n_chunks = 0 THEN 'no chunks' END, CASE WHEN n_embeddings != n_chunks THEN 'embeddings differ from chunks' END, CASE WHEN n_entries != n_embeddings THEN 'index differs from embeddings' END, CASE WHEN k > 1 THEN 'mixed dimensions' END) AS problems FROM r)
SELECT document_id, n_chunks, n_embeddings, n_entries, problems, problems = '' AS ready FROM p"""


def version_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are documents' versions: a customer's orders by date."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("version_number"))
    return registry.supersede(o).groupBy("document_id").agg(F.count("*").alias("n_versions"), F.count_if(F.col("status") == "ACTIVE").alias("n_active"), F.max("next_number").alias("next_number"))


def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as writes of a customer's row: last one wins, the first one's time stays."""
    log = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.struct("o_orderdate", "o_orderkey").alias("at"))
    out = registry.upsert(log, ["o_custkey"], "at")
    return out.select("o_custkey", "o_orderkey", "o_orderstatus", F.col("created_at.o_orderkey").alias("first_orderkey"))


# --- lifecycle ------------------------------------------------------------------------------------------------

_STATE = lifecycle.STATES


def state_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as a document's events: mostly the next state, at times another."""
    li = table(spark, sf_dir, "lineitem")
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    step = F.when(F.col("l_partkey") % 9 == 0, F.lit(8)).when(F.col("l_partkey") % 11 == 0, F.lit(3)).otherwise(F.least(F.col("seq") - 1, F.lit(7)))
    return li.withColumn("seq", seq).select(F.col("l_orderkey").alias("document_id"), "seq", F.get(F.array(*map(F.lit, _STATE)), step).alias("state"))


def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.checked_transitions(state_events(spark, sf_dir))


_EVENTS = f"""ordered AS (SELECT l_orderkey AS document_id, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INTEGER AS seq FROM lineitem),
states AS (SELECT document_id, seq, (['{"', '".join(_STATE)}'])[CASE WHEN l_partkey % 9 = 0 THEN 9 WHEN l_partkey % 11 = 0 THEN 4 ELSE least(seq, 8) END] AS state FROM ordered)"""
_ALLOWED = "(" + ", ".join(f"('{a}', '{b}')" for a, b in lifecycle.TRANSITIONS) + ")"


def current_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.current_states(state_events(spark, sf_dir)).groupBy("state").agg(F.count("*").alias("n"))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as job events: the user is the document, each 3 events of a user are a job."""
    e = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    status = F.when(F.col("n") % 3 == 0, "PENDING").when(F.col("n") % 3 == 1, "RUNNING").when(F.col("event_type") == "click", "FAILED").otherwise("COMPLETED")
    return e.withColumn("n", n).select((F.col("user_id") * 1000000 + F.floor(F.col("n") / 3)).alias("job_id"), F.col("user_id").alias("document_id"), F.lit("process").alias("job_type"), status.alias("status"), "ts")


def job_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.jobs(job_events(spark, sf_dir)).select("job_id", "document_id", "last_status", "created_at", "started_at", "completed_at", F.round("duration_ms", 3).alias("duration_ms"))


_JOBS = """numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
steps AS (SELECT user_id * 1000000 + n // 3 AS job_id, user_id AS document_id, CASE WHEN n % 3 = 0 THEN 'PENDING' WHEN n % 3 = 1 THEN 'RUNNING' WHEN event_type = 'click' THEN 'FAILED' ELSE 'COMPLETED' END AS status, ts FROM numbered),
jobs AS (SELECT job_id, document_id, arg_max(status, {'ts': ts, 's': status}) AS last_status, min(ts) AS created_at, min(ts) FILTER (status = 'RUNNING') AS started_at, max(ts) FILTER (status IN ('COMPLETED', 'FAILED')) AS completed_at FROM steps GROUP BY ALL)"""


def contested_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose jobs still run at the end of the events."""
    rows = lifecycle.jobs(job_events(spark, sf_dir))
    active = rows.withColumn("job_type", F.when(F.col("job_id") % 2 == 0, "even").otherwise("odd")).withColumn("document_id", F.col("document_id") % 25)
    return lifecycle.contested(active)


def first_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = state_events(spark, sf_dir).select((F.col("document_id") % 500).alias("document_id"), F.col("state").alias("from_state"), (F.col("document_id") * 10 + F.col("seq")).alias("seq"))
    return lifecycle.first_claims(claims).where("won").select("document_id", "from_state", "seq")


def release_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are releases, lineitems their checks."""
    li = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "A", "PASS").when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 48), "FAIL").when(F.col("l_linestatus") == "O", "SKIP").otherwise("PENDING")
    return lifecycle.release_report(li.select(F.col("l_suppkey").alias("release_id"), status.alias("status"), (F.col("l_discount") > 0.09).alias("critical")))


QUERIES = {
    "registry_filter_page": registry_filter_page,
    "registry_counts": registry_counts,
    "authorized_scope": authorized_scope,
    "scope_status": scope_status,
    "relationships_union": relationships_union,
    "tag_normalize": tag_normalize,
    "tag_filter": tag_filter,
    "upload_gate": upload_gate,
    "registry_pages": registry_pages,
    "tag_options": tag_options,
    "checksum_duplicates": checksum_duplicates,
    "html_text_extract": html_text_extract,
    "index_stats": index_stats,
    "outdated_embeddings": outdated_embeddings,
    "ready_validation": ready_validation,
    "version_supersede": version_supersede,
    "registry_upsert": registry_upsert,
    "state_transitions": state_transitions,
    "current_states": current_states,
    "job_lifecycle": job_lifecycle,
    "contested_jobs": contested_jobs,
    "first_claims": first_claims,
    "release_checklist": release_checklist,
}
SQL = {
    "registry_filter_page": f"WITH {_REGISTERED}, f AS (SELECT * FROM registered WHERE vault_id = 'src3' AND status = 'ACTIVE') SELECT document_id, language, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > 25 AS has_more FROM f ORDER BY document_id DESC LIMIT 20 OFFSET 5",
    "registry_counts": f"WITH {_REGISTERED} SELECT vault_id, status, count(*) AS n_documents, count(DISTINCT language) AS n_languages FROM registered GROUP BY ALL",
    "authorized_scope": f"WITH {_UPLOAD} SELECT * FROM scopes",
    "scope_status": SCOPE_SQL,
    "relationships_union": "WITH e AS (SELECT l_suppkey::BIGINT AS s, (l_partkey % 97)::BIGINT AS t, CASE l_returnflag WHEN 'A' THEN 'AMENDS' WHEN 'R' THEN 'SUPERSEDES' ELSE 'REFERENCES' END AS kind FROM lineitem) SELECT s AS document_id, t AS other_id, kind FROM e UNION SELECT t, s, kind FROM e",
    "tag_normalize": f"WITH {_TAGS} SELECT p_partkey, string_agg(tag, '|' ORDER BY k) AS tags, count(*) AS n_tags FROM tags GROUP BY p_partkey",
    "tag_filter": f"WITH {_TAGS} SELECT tag, count(*) AS n_parts FROM tags WHERE length(tag) > 4 GROUP BY tag",
    "upload_gate": UPLOAD_SQL,
    "registry_pages": _PAGES_SQL,
    "tag_options": _OPTIONS_SQL,
    "checksum_duplicates": "SELECT sha256(text) AS checksum, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "html_text_extract": _html_sql(),
    "index_stats": "SELECT count(*) AS total, count(*) FILTER (label < 8) AS active, count(DISTINCT label % 2) AS models, count(DISTINCT len(embedding)) AS dimensions FROM embeddings",
    "outdated_embeddings": "SELECT vec_id, 'ACTIVE' AS status, CASE WHEN label % 2 = 0 THEN 'bge' ELSE 'nomic' END AS model, (label % 3)::VARCHAR AS model_version FROM embeddings WHERE label < 8 AND (label % 2 != 0 OR label % 3 != 0)",
    "ready_validation": READY_SQL,
    "version_supersede": "SELECT o_custkey AS document_id, count(*) AS n_versions, 1::BIGINT AS n_active, (count(*) + 1)::INTEGER AS next_number FROM orders GROUP BY o_custkey",
    "registry_upsert": "SELECT o_custkey, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS o_orderkey, arg_max(o_orderstatus, {'d': o_orderdate, 'k': o_orderkey}) AS o_orderstatus, arg_min(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS first_orderkey FROM orders GROUP BY o_custkey",
    "state_transitions": f"WITH {_EVENTS}, p AS (SELECT *, lag(state) OVER (PARTITION BY document_id ORDER BY seq) AS previous FROM states) SELECT document_id, seq, state, previous, CASE WHEN previous IS NULL THEN state = 'UPLOADED' ELSE (previous, state) IN {_ALLOWED} END AS valid FROM p",
    "current_states": f"WITH {_EVENTS}, c AS (SELECT document_id, arg_max(state, seq) AS state FROM states GROUP BY document_id) SELECT state, count(*) AS n FROM c GROUP BY state",
    "job_lifecycle": f"WITH {_JOBS} SELECT *, round(date_diff('microsecond', started_at, completed_at) / 1000.0::DOUBLE, 3) AS duration_ms FROM jobs",
    "contested_jobs": f"WITH {_JOBS} SELECT document_id % 25 AS document_id, CASE WHEN job_id % 2 = 0 THEN 'even' ELSE 'odd' END AS job_type, count(*) AS n_active FROM jobs WHERE last_status IN ('PENDING', 'RUNNING') GROUP BY 1, 2 HAVING count(*) > 1",
    "first_claims": f"WITH {_EVENTS} SELECT document_id % 500 AS document_id, state AS from_state, min(document_id * 10 + seq) AS seq FROM states GROUP BY 1, 2",
    "release_checklist": """WITH c AS (SELECT l_suppkey AS release_id, CASE WHEN l_returnflag = 'A' THEN 'PASS' WHEN l_returnflag = 'R' AND l_quantity > 48 THEN 'FAIL' WHEN l_linestatus = 'O' THEN 'SKIP' ELSE 'PENDING' END AS status, l_discount > 0.09::DOUBLE AS critical FROM lineitem),
s AS (SELECT release_id, count(*) AS total, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (status = 'SKIP') AS skipped, count(*) FILTER (status = 'FAIL' AND critical) AS critical_failures FROM c GROUP BY release_id)
SELECT *, round(CASE WHEN total = skipped THEN 1 ELSE passed::DOUBLE / (total - skipped) END, 6) AS pass_rate, critical_failures = 0 AS can_release FROM s""",
}
