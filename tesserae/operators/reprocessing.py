"""Reprocessing of documents from a stage on: what is refused, what is built anew, what becomes stale.

Stages in order: ocr, parse, embed, index. Each builds on the artefacts before it and makes those after it void, so a request names
the earliest stage that runs and all after it follow. Requests of a document take effect in the order of seq; what an earlier one has built
is there for a later one.

Rules: a request of an unknown stage or document changes nothing. ``parse`` needs a result of the current version, ``embed`` and ``index`` its
chunks; that is looked at before anything else. An archived document has to be restored first; one without a state can't be requeued. Then the document
goes back to the state before the stage (UPLOADED, OCR_COMPLETED or PARSING_RUNNING), also from READY. ``index`` at last needs one
active vector of the current model for every chunk. All but ``index`` make the vectors stale; all that run delete the index rows. An error
makes a document that is under way FAILED; one that was READY or FAILED before it was requeued stays so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.lifecycle import IN_FLIGHT

STAGES = ("ocr", "parse", "embed", "index")
#: State that a document is put back to, and what is built anew, by stage.
TARGETS = {"ocr": "UPLOADED", "parse": "OCR_COMPLETED", "embed": "PARSING_RUNNING", "index": "PARSING_RUNNING"}
BUILT = {"ocr": ["results", "trees", "chunks", "embeddings", "entries"], "parse": ["trees", "chunks", "embeddings", "entries"], "embed": ["embeddings", "entries"], "index": ["entries"]}


def _by_stage(values: dict[str, str]) -> Column:
    out = F.when(F.col("stage") == "ocr", F.lit(values["ocr"]))
    for s in STAGES[1:]:
        out = out.when(F.col("stage") == s, F.lit(values[s]))
    return out


def outcomes(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """Of each request: document_id, seq, stage, error (null: done), target, built, stale, unindexed, state afterwards.

    requests: document_id, seq (unique in a document), stage. documents: document_id, status, state (or null), has_result, n_chunks,
    n_vectors (active ones of the current model and version). One shuffle by document.
    """
    known = documents.select("document_id", "status", F.col("state").alias("before"), "has_result", "n_chunks", "n_vectors", F.lit(True).alias("known"))
    rows = requests.select("document_id", "seq", F.lower(F.trim("stage")).alias("stage")).join(known, "document_id", "left")
    past = Window.partitionBy("document_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("document_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    earlier = lambda c: F.coalesce(F.max(c).over(past), F.lit(False))
    at = lambda *stages: F.col("stage").isin(*stages)
    has = lambda c: F.coalesce(c, F.lit(False))
    able = has(F.col("known")) & at(*STAGES) & has(F.col("status") != "ARCHIVED") & F.col("before").isNotNull()
    rows = rows.withColumn("ocr_done", able & at("ocr"))
    rows = rows.withColumn("result", has(F.col("has_result")) | earlier("ocr_done"))
    rows = rows.withColumn("parse_done", able & at("parse") & F.col("result"))
    rows = rows.withColumn("chunks", has(F.col("n_chunks") > 0) | earlier("ocr_done") | earlier("parse_done"))
    rows = rows.withColumn("embed_done", able & at("embed") & F.col("chunks"))
    rows = rows.withColumn("vectors", has((F.col("n_chunks") > 0) & (F.col("n_vectors") == F.col("n_chunks"))) | earlier("ocr_done") | earlier("parse_done") | earlier("embed_done"))
    error = (
        F.when(~at(*STAGES) | F.col("stage").isNull(), "unsupported stage")
        .when(F.col("known").isNull(), "document not found")
        .when(at("parse") & ~F.col("result"), "re-parse needs a result")
        .when(at("embed", "index") & ~F.col("chunks"), "re-embed and re-index need chunks")
        .when(F.col("status") == "ARCHIVED", "archived documents must be restored first")
        .when(F.col("before").isNull(), "no processing state")
        .when(at("index") & ~F.col("vectors"), "re-index needs one active vector for every chunk")
    )
    rows = rows.withColumn("error", error)
    done, requeued = F.col("error").isNull(), able & (F.col("error").isNull() | (at("index") & F.col("chunks") & ~F.col("vectors")))
    # What sets the state whatever it was; any other error only stops a document that is under way.
    told = F.when(done, "READY").when(requeued, "FAILED")
    stopped = F.col("known") & at(*STAGES) & ~done & F.col("before").isin(*IN_FLIGHT)
    rows = rows.withColumns({"told": F.last(told, ignorenulls=True).over(so_far), "stopped": F.coalesce(F.max(stopped).over(so_far), F.lit(False))})
    return rows.select(
        "document_id", "seq", "stage", "error", F.when(requeued, _by_stage(TARGETS)).alias("target"), F.when(done, _by_stage({s: " ".join(t) for s, t in BUILT.items()})).alias("built"),
        (done & ~at("index")).alias("stale"), done.alias("unindexed"), F.coalesce("told", F.when(F.col("stopped"), "FAILED"), "before").alias("state"),
    )


def states(documents: DataFrame, done: DataFrame) -> DataFrame:
    """document_id, state of every document after all requests."""
    last = done.groupBy("document_id").agg(F.max_by("state", "seq").alias("after"), F.lit(True).alias("asked"))
    rows = documents.select("document_id", "state").join(last, "document_id", "left")
    return rows.select("document_id", F.when(F.col("asked"), F.col("after")).otherwise(F.col("state")).alias("state"))


def marked(embeddings: DataFrame, done: DataFrame) -> DataFrame:
    """embeddings with those of documents that were processed from before the index as STALE; no row is removed."""
    of = done.where("stale").select("document_id").distinct().withColumn("__stale", F.lit(True))
    rows = embeddings.join(of, "document_id", "left")
    return rows.withColumn("status", F.when(F.col("__stale"), "STALE").otherwise(F.col("status"))).select(*embeddings.columns)


def unindexed(entries: DataFrame, done: DataFrame) -> DataFrame:
    """Index rows but for those of documents that were processed again, whose new ones come from the stages that ran."""
    return entries.join(done.where("unindexed").select("document_id").distinct(), "document_id", "left_anti")
