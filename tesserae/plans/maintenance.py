"""Queries over tables that change: snapshots of index rows, merged logs with cascades, reprocessing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import merging, reprocessing
from tesserae.operators.lifecycle import IN_FLIGHT
from tesserae.plans.common import table
from tesserae.plans.registry import _REGISTERED, registered
from tesserae.sources import snapshots
from tesserae.sources.shared import fresh

# --- snapshots -------------------------------------------------------------------------------------------------

MODELS = ["model", "model_version"]


def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as index rows of three models."""
    e, v = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    return e.select(
        v.alias("entry_id"), F.col("embedding").alias("vector"), F.size("embedding").alias("dimension"), F.when(v % 11 == 0, "STALE").otherwise("ACTIVE").alias("status"),
        F.concat(F.lit("m"), (v % 3).cast("string")).alias("model"), F.lit("v1").alias("model_version"),
    )


def index_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers see before, during and after the model m0 is rebuilt from its active rows as version v2; and of m1 alone."""
    root, rows = fresh(spark, "index"), index_rows(spark, sf_dir)
    first = snapshots.publish(rows, root, MODELS)
    before = snapshots.read(spark, root)
    rebuilt = rows.where("model = 'm0' AND status = 'ACTIVE'").withColumn("model_version", F.lit("v2"))
    run, parts = snapshots.write_run(rebuilt, root, MODELS)
    during = snapshots.read(spark, root)
    kept = {p: r for p, r in first.parts.items() if not p.startswith("model=m0/")}
    second = snapshots.commit(spark, root, first, MODELS, first.schema, kept | {p: [run] for p in parts})
    seen = {"before": before, "during": during, "after": snapshots.read(spark, root), "m1": snapshots.read(spark, root, parts=[snapshots.part(MODELS, ("m1", "v1"))], of=second)}
    every = reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("reader"), *MODELS, "entry_id", "status", "vector") for k, df in seen.items()])
    length = F.aggregate(F.filter("vector", lambda x: x.isNotNull()), F.lit(0).cast("long"), lambda n, _: n + 1)
    return every.groupBy("reader", *MODELS).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ACTIVE").alias("n_active"), F.sum("entry_id").alias("ids"), F.sum(length).alias("n_numbers"))


_ROWS = "SELECT vec_id AS entry_id, embedding AS vector, CASE WHEN vec_id % 11 = 0 THEN 'STALE' ELSE 'ACTIVE' END AS status, 'm' || (vec_id % 3) AS model, 'v1' AS model_version FROM embeddings"
SNAPSHOT_SQL = f"""WITH one AS ({_ROWS}), two AS (SELECT * FROM one WHERE model != 'm0' UNION ALL SELECT * REPLACE ('v2' AS model_version) FROM one WHERE model = 'm0' AND status = 'ACTIVE'),
every AS (SELECT 'before' AS reader, * FROM one UNION ALL SELECT 'during', * FROM one UNION ALL SELECT 'after', * FROM two UNION ALL SELECT 'm1', * FROM two WHERE model = 'm1')
SELECT reader, model, model_version, count(*) AS n, count(*) FILTER (status = 'ACTIVE') AS n_active, sum(entry_id)::BIGINT AS ids, sum(len(list_filter(vector, lambda x: x IS NOT NULL)))::BIGINT AS n_numbers FROM every GROUP BY ALL"""

# --- merged logs -----------------------------------------------------------------------------------------------

#: Characters of a piece; hash buckets of the logs, few as the tables here are small.
PIECE, BUCKETS = 4000, 16
TABLES = ("documents", "chunks", "embeddings", "entries")


def _first_writes(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), F.col("vec_id").alias("item"), (F.col("label") + 1).cast("long").alias("amount"))
    pieces = d.select("document_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n div {PIECE}"))).alias("item"))
    found = {"documents": d.select("document_id", F.lit(0).cast("long").alias("item"), F.col("n").alias("amount")), "chunks": pieces.withColumn("amount", F.col("item") + 1), "embeddings": v, "entries": v.where("item % 7 != 0")}
    return {name: _writes(df, 1) for name, df in found.items()}


def _writes(rows: DataFrame, seq: int, deleted: bool = False) -> DataFrame:
    return rows.select("document_id", "item", F.lit(seq).cast("long").alias("seq"), F.lit(deleted).alias("deleted"), "amount")


def _logs(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Four logs: first writes; changed documents and dropped first chunks; a cascade of toxic documents; some of these again."""
    first, roots = _first_writes(spark, sf_dir), {t: fresh(spark, f"log-{t}") for t in TABLES}
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("document_id"))
    for name in TABLES:
        merging.appended(first[name], roots[name], BUCKETS)
    changed = first["documents"].where("document_id % 10 = 3")
    merging.appended(_writes(changed.withColumn("amount", F.col("amount") + 1), 2), roots["documents"], BUCKETS)
    merging.appended(_writes(first["chunks"].where("document_id % 10 = 3 AND item = 0").withColumn("amount", F.lit(None).cast("long")), 2, True), roots["chunks"], BUCKETS)
    merging.cascaded(gone, 3, list(roots.values()), BUCKETS)
    merging.appended(_writes(first["documents"].join(gone, "document_id", "left_semi").where("document_id % 2 = 0").withColumn("amount", F.lit(0).cast("long")), 4), roots["documents"], BUCKETS)
    return roots


def merged_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table before and after its changed buckets are merged: the same rows."""
    roots, out = _logs(spark, sf_dir), []
    for name, root in roots.items():
        base = snapshots.snapshot(spark, root)
        merging.compacted(spark, root)
        for merged, df in ((False, merging.current(spark, root, of=base)), (True, merging.current(spark, root))):
            out.append(df.select(F.lit(name).alias("name"), F.lit(merged).alias("merged"), "document_id", "item", "seq", "amount"))
    every = reduce(DataFrame.unionByName, out)
    return every.groupBy("name", "merged").agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("n_documents"), F.sum("amount").alias("amount"), F.sum("seq").alias("writes"), F.sum("item").alias("items"))


MERGED_SQL = f"""WITH d AS (SELECT doc_id AS document_id, length(coalesce(text, '')) AS n FROM documents), v AS (SELECT vec_id AS document_id, vec_id AS item, label + 1 AS amount FROM embeddings), gone AS (SELECT DISTINCT doc_id AS document_id FROM labels WHERE toxic = 1),
c AS (SELECT document_id, unnest(range(0, n // {PIECE} + 1)) AS item FROM d),
log AS (
  SELECT 'documents' AS name, document_id, 0 AS item, 1 AS seq, false AS deleted, n AS amount FROM d UNION ALL SELECT 'chunks', document_id, item, 1, false, item + 1 FROM c
  UNION ALL SELECT 'embeddings', document_id, item, 1, false, amount FROM v UNION ALL SELECT 'entries', document_id, item, 1, false, amount FROM v WHERE item % 7 != 0
  UNION ALL SELECT 'documents', document_id, 0, 2, false, n + 1 FROM d WHERE document_id % 10 = 3 UNION ALL SELECT 'chunks', document_id, item, 2, true, NULL FROM c WHERE document_id % 10 = 3 AND item = 0
  UNION ALL SELECT name, document_id, NULL, 3, true, NULL FROM gone, (SELECT unnest({list(TABLES)}) AS name)
  UNION ALL SELECT 'documents', document_id, 0, 4, false, 0 FROM d SEMI JOIN gone USING (document_id) WHERE document_id % 2 = 0
),
ends AS (SELECT name, document_id, max(seq) AS last FROM log WHERE deleted AND item IS NULL GROUP BY ALL),
kept AS (SELECT log.* FROM log LEFT JOIN ends USING (name, document_id) WHERE item IS NOT NULL AND (last IS NULL OR seq > last) QUALIFY row_number() OVER (PARTITION BY name, document_id, item ORDER BY seq DESC, deleted DESC) = 1),
live AS (SELECT * FROM kept WHERE NOT deleted)
SELECT name, merged, count(*) AS n, count(DISTINCT document_id) AS n_documents, sum(amount)::BIGINT AS amount, sum(seq)::BIGINT AS writes, sum(item)::BIGINT AS items FROM live, (SELECT unnest([false, true]) AS merged) GROUP BY ALL"""

# --- reprocessing ----------------------------------------------------------------------------------------------

_ASKED = ("OCR", " parse ", "embed", "Index", "tidy")
_BEFORE = ("UPLOADED", "OCR_RUNNING", "READY", "READY", "READY", "FAILED", "PARSING_RUNNING", "READY", None, "READY")


def _processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with what each stage has left, by rules of their ids."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(i.alias("document_id"), F.when(i % 4 == 0, 0).otherwise(F.expr(f"length(coalesce(text, '')) div {PIECE} + 1")).alias("n_chunks"))
    n, i = F.col("n_chunks"), F.col("document_id")
    state = F.get(F.array(*map(F.lit, _BEFORE)), (i % 10).cast("int"))
    d = d.select("document_id", state.alias("state"), (i % 3 != 0).alias("has_result"), "n_chunks", F.when(i % 6 == 1, n - 1).otherwise(n).alias("n_vectors"))
    return d.join(registered(spark, sf_dir).select("document_id", "status"), "document_id")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to three requests of each document, and some of documents that there aren't."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(i, F.explode(F.sequence(F.lit(1), (i % 3 + 1).cast("int"))).alias("seq"))
    d = d.withColumn("stage", F.get(F.array(*map(F.lit, _ASKED)), ((F.expr("doc_id div 7") + F.col("seq") * 3) % 5).cast("int")))
    return d.select(i.alias("document_id"), "seq", "stage").unionByName(d.where("doc_id % 101 = 0").select((-i - 1).alias("document_id"), "seq", "stage"))


def reprocess_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reprocessing.outcomes(_requests(spark, sf_dir), _processed(spark, sf_dir))


def reprocessed_artefacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document after all requests: its state, its vectors by status, its index rows."""
    base = _processed(spark, sf_dir)
    done = reprocessing.outcomes(_requests(spark, sf_dir), base)
    vectors = base.where("n_vectors > 0").select("document_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_vectors").cast("long"))).alias("embedding_id"), F.lit("ACTIVE").alias("status"))
    marked = reprocessing.marked(vectors, done).groupBy("document_id").agg(F.count_if(F.col("status") == "ACTIVE").alias("n_active"), F.count_if(F.col("status") == "STALE").alias("n_stale"))
    entries = reprocessing.unindexed(vectors, done).groupBy("document_id").agg(F.count("*").alias("n_entries"))
    rows = reprocessing.states(base, done).join(marked, "document_id", "left").join(entries, "document_id", "left")
    return rows.na.fill(0, ["n_active", "n_stale", "n_entries"])


_OUTCOMES = f"""{_REGISTERED},
base AS (SELECT doc_id AS document_id, status, {list(_BEFORE)!r}[doc_id % 10 + 1] AS before, doc_id % 3 != 0 AS has_result, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE length(coalesce(text, '')) // {PIECE} + 1 END AS n_chunks FROM documents JOIN registered ON document_id = doc_id),
docs AS (SELECT *, CASE WHEN document_id % 6 = 1 THEN n_chunks - 1 ELSE n_chunks END AS n_vectors, true AS known FROM base),
numbered AS (SELECT doc_id, unnest(range(1, doc_id % 3 + 2)) AS seq FROM documents),
named AS (SELECT doc_id, seq, {list(_ASKED)!r}[(doc_id // 7 + seq * 3) % 5 + 1] AS stage FROM numbered),
requests AS (SELECT doc_id AS document_id, seq, stage FROM named UNION ALL SELECT -doc_id - 1, seq, stage FROM named WHERE doc_id % 101 = 0),
r0 AS (SELECT document_id, seq, lower(trim(stage)) AS stage, status, before, has_result, n_chunks, n_vectors, coalesce(known, false) AS known FROM requests LEFT JOIN docs USING (document_id)),
r1 AS (SELECT *, known AND stage != 'tidy' AND status != 'ARCHIVED' AND before IS NOT NULL AS able FROM r0),
r2 AS (SELECT *, coalesce(able AND stage = 'ocr', false) AS o FROM r1),
r3 AS (SELECT *, coalesce(has_result, false) OR coalesce(bool_or(o) OVER past, false) AS result FROM r2 WINDOW past AS (PARTITION BY document_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r4 AS (SELECT *, coalesce(able AND stage = 'parse' AND result, false) AS p FROM r3),
r5 AS (SELECT *, coalesce(n_chunks > 0, false) OR coalesce(bool_or(o OR p) OVER past, false) AS chunks FROM r4 WINDOW past AS (PARTITION BY document_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r6 AS (SELECT *, coalesce(able AND stage = 'embed' AND chunks, false) AS e FROM r5),
r7 AS (SELECT *, coalesce(n_chunks > 0 AND n_vectors = n_chunks, false) OR coalesce(bool_or(o OR p OR e) OVER past, false) AS vectors FROM r6 WINDOW past AS (PARTITION BY document_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r8 AS (SELECT *, CASE WHEN stage = 'tidy' THEN 'unsupported stage' WHEN NOT known THEN 'document not found' WHEN stage = 'parse' AND NOT result THEN 're-parse needs a result' WHEN stage IN ('embed', 'index') AND NOT chunks THEN 're-embed and re-index need chunks'
  WHEN status = 'ARCHIVED' THEN 'archived documents must be restored first' WHEN before IS NULL THEN 'no processing state' WHEN stage = 'index' AND NOT vectors THEN 're-index needs one active vector for every chunk' END AS error FROM r7),
r9 AS (SELECT *, error IS NULL AS done, error IS NULL OR starts_with(error, 're-index needs one') AS requeued FROM r8),
outcomes AS (SELECT document_id, seq, stage, error, CASE WHEN requeued THEN CASE stage WHEN 'ocr' THEN 'UPLOADED' WHEN 'parse' THEN 'OCR_COMPLETED' ELSE 'PARSING_RUNNING' END END AS target,
  CASE WHEN done THEN CASE stage WHEN 'ocr' THEN 'results trees chunks embeddings entries' WHEN 'parse' THEN 'trees chunks embeddings entries' WHEN 'embed' THEN 'embeddings entries' ELSE 'entries' END END AS built,
  done AND stage != 'index' AS stale, done AS unindexed,
  coalesce(last_value(CASE WHEN done THEN 'READY' WHEN requeued THEN 'FAILED' END IGNORE NULLS) OVER upto, CASE WHEN bool_or(known AND stage != 'tidy' AND NOT done AND before IN {IN_FLIGHT}) OVER upto THEN 'FAILED' END, before) AS state
  FROM r9 WINDOW upto AS (PARTITION BY document_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""".replace("None", "NULL")
OUTCOMES_SQL = f"WITH {_OUTCOMES} SELECT * FROM outcomes"
REPROCESSED_SQL = f"""WITH {_OUTCOMES}, last AS (SELECT document_id, arg_max(state, seq) AS told, bool_or(stale) AS stale, bool_or(unindexed) AS unindexed FROM (SELECT * REPLACE (coalesce(state, '-') AS state) FROM outcomes) GROUP BY ALL)
SELECT d.document_id, nullif(coalesce(told, before), '-') AS state, CASE WHEN stale THEN 0 ELSE greatest(n_vectors, 0) END::BIGINT AS n_active, CASE WHEN stale THEN greatest(n_vectors, 0) ELSE 0 END::BIGINT AS n_stale, CASE WHEN unindexed THEN 0 ELSE greatest(n_vectors, 0) END::BIGINT AS n_entries FROM docs d LEFT JOIN last USING (document_id)"""

QUERIES = {"index_snapshots": index_snapshots, "merged_logs": merged_logs, "reprocess_outcomes": reprocess_outcomes, "reprocessed_artefacts": reprocessed_artefacts}
SQL = {"index_snapshots": SNAPSHOT_SQL, "merged_logs": MERGED_SQL, "reprocess_outcomes": OUTCOMES_SQL, "reprocessed_artefacts": REPROCESSED_SQL}
