"""Artefact tables of document versions (extraction results, trees, chunks, vectors, index rows) and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.registry import filtered, latest

KEY = ["document_id", "version_id"]


def append(rows: DataFrame, path: str) -> None:
    """Adds rows of an artefact (document_id, version_id, created_at, ...) to its table; nothing is overwritten."""
    rows.write.mode("append").parquet(path)


def newest(spark: SparkSession, path: str, order: str = "created_at") -> DataFrame:
    """The newest artefact of each document version."""
    return latest(spark.read.parquet(path), KEY, order)


def of_version(spark: SparkSession, path: str, document_id, version_id) -> DataFrame:
    """All rows of one version, newest first; the filters reach the scan."""
    return filtered(spark.read.parquet(path), document_id=document_id, version_id=version_id).orderBy(F.desc("created_at"))


def searchable(entries: DataFrame, dimension: int | None = None, **conditions) -> DataFrame:
    """Index rows that a search may see: active, of the query's dimension, and meeting every condition that is given.

    Conditions are columns by value or list: vault_id, document_id, document_status, chunk_type, model, model_version, language.
    """
    kept = filtered(entries.where("status = 'ACTIVE'"), **conditions)
    return kept if dimension is None else kept.where(F.col("dimension") == dimension)


def by_chunk(chunks: DataFrame, embeddings: DataFrame, entries: DataFrame) -> DataFrame:
    """Chunks with the ids of their active vector and index row, null where there is none: chunk_id, embedding_id, entry_id."""
    active = lambda df, own: df.where("status = 'ACTIVE'").select(*own)
    vectors = active(embeddings, ["chunk_id", "embedding_id"])
    rows = active(entries, ["embedding_id", "entry_id"])
    # Vectors meet their index rows first: chunks without a vector would all be dealt to one task by a null id.
    return chunks.select(*KEY, "chunk_id").join(vectors.join(rows, "embedding_id", "left"), "chunk_id", "left").select(*KEY, "chunk_id", "embedding_id", "entry_id")


def collection_totals(chunks: DataFrame) -> DataFrame:
    """Chunks and tokens of each collection."""
    return chunks.groupBy(*KEY).agg(F.count("*").alias("n_chunks"), F.sum("tokens").alias("n_tokens"))


def newest_collection(collections: DataFrame) -> DataFrame:
    """Of each version's newest collection: chunks that it declares, lists, and tells apart."""
    of = [c for c in ("created_at", "collection_id") if c in collections.columns]
    each = collections.groupBy(*KEY, *of).agg(F.max("n_declared").alias("declared"), F.count("*").alias("listed"), F.count_distinct("chunk_id").alias("chunk_ids"))
    if not of:
        return each
    newest = each.groupBy(*KEY).agg(F.max_by(F.struct("declared", "listed", "chunk_ids"), F.struct(*of)).alias("c"))
    return newest.select(*KEY, "c.*")


def version_problems(versions: DataFrame, results: DataFrame, trees: DataFrame, collections: DataFrame, embeddings: DataFrame, entries: DataFrame, model: str, model_version: str, dimension: int) -> DataFrame:
    """What keeps each version from being ready: versions' keys, problems (joined by '; '), ready.

    results, trees: keys; collections: keys, chunk_id, n_declared, and where a version may have several, collection_id and created_at: the
    newest alone counts; embeddings: keys, chunk_id, status, model, model_version, dimension; entries: these and embedding_id. Only
    active rows of the configured model count, and each chunk must be covered exactly once. Sides are counted by version before they are joined.
    """
    current = (F.col("status") == "ACTIVE") & (F.col("model") == model) & (F.col("model_version") == model_version) & (F.col("dimension") == dimension)
    count = lambda df, *sums: df.groupBy(*KEY).agg(*sums)
    sides = [
        count(results, F.count("*").alias("n_results")),
        count(trees, F.count("*").alias("n_trees")),
        newest_collection(collections),
        count(embeddings.where(current), F.count("*").alias("n_vectors"), F.count_distinct("chunk_id").alias("vector_chunks")),
        count(entries.where(current), F.count("*").alias("n_entries"), F.count_distinct("chunk_id").alias("entry_chunks"), F.count_distinct("embedding_id").alias("entry_vectors")),
    ]
    rows = versions.select(*KEY)
    for side in sides:
        rows = rows.join(side, KEY, "left")
    rows = rows.na.fill(0)
    n = F.col("declared")
    covers = lambda *c: (n > 0) & F.forall(F.array(*c), lambda x: x == n)
    tests: list[tuple[Column, str]] = [
        (F.col("n_results") < 1, "no extraction result"), (F.col("n_trees") < 1, "no tree"), (n < 1, "no chunks"), ((n > 0) & ((F.col("listed") != n) | (F.col("chunk_ids") != n)), "inconsistent chunks"),
        (~covers("n_vectors", "vector_chunks"), "vectors don't cover the chunks"), (~covers("n_entries", "entry_chunks", "entry_vectors"), "index doesn't cover the vectors"),
    ]
    problems = F.array_compact(F.array(*[F.when(t, F.lit(p)) for t, p in tests]))
    return rows.select(*KEY, F.array_join(problems, "; ").alias("problems"), (F.size(problems) == 0).alias("ready"))


def restored(documents: DataFrame, problems: DataFrame) -> DataFrame:
    """Archived documents that may be active again: those whose current version is ready. Adds restored and reason."""
    known = problems.select(*KEY, "problems", "ready")
    rows = documents.join(known, KEY, "left")
    ok = (F.col("status") == "ARCHIVED") & F.coalesce("ready", F.lit(False))
    reason = F.when(F.col("status") != "ARCHIVED", "not archived").when(F.col("ready").isNull(), "no artefacts").when(~F.col("ready"), F.col("problems"))
    return rows.withColumns({"status": F.when(ok, "ACTIVE").otherwise(F.col("status")), "restored": ok, "reason": reason}).drop("problems", "ready")


def requeued(states: DataFrame, jobs: DataFrame) -> DataFrame:
    """Documents that failed and have no job that waits or runs, back as uploaded. states: document_id, state; jobs: document_id, last_status."""
    busy = jobs.where(F.col("last_status").isin("PENDING", "RUNNING")).select("document_id").distinct()
    return states.where("state = 'FAILED'").join(busy, "document_id", "left_anti").select("document_id", F.lit("UPLOADED").alias("state"))


def assigned(documents: DataFrame, events: DataFrame) -> DataFrame:
    """document_id, vault_id after all assignments (document_id, seq, vault_id; a null vault takes a document out of its vault)."""
    last = latest(events, ["document_id"], "seq").select("document_id", F.col("vault_id").alias("told"), F.lit(True).alias("any"))
    rows = documents.join(last, "document_id", "left")
    return rows.select("document_id", F.when(F.col("any"), F.col("told")).otherwise(F.col("vault_id")).alias("vault_id"))
