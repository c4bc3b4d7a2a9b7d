"""Claims of an answer and the evidence for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import text as tx


def sentences(answers: DataFrame, first: int | None = None) -> DataFrame:
    """answer_id, sentence_index (from 0), sentence, start_char; with first, only that many sentences of an answer."""
    found = tx.sentences("content")
    kept = found if first is None else F.slice(found, 1, first)
    rows = answers.select("answer_id", F.posexplode(kept).alias("sentence_index", "sentence"))
    before = Window.partitionBy("answer_id").orderBy("sentence_index").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start_char", F.coalesce(F.sum(F.length("sentence") + 1).over(before), F.lit(0)))


def claims(answers: DataFrame, first: int = 5) -> DataFrame:
    """answer_id, sentence_index, claim_no (in its sentence), claim_type, claim, start_char, end_char: references, the sentence, dates.

    A sentence that is all reference gives its references only. Offsets are in the answer's sentences joined by one character; a reference
    is placed where its text stands first in the sentence, a date where it was found.
    """
    rows = sentences(answers, first).withColumns({"kind": tx.claim_type("sentence"), "refs": tx.legal_references("sentence"), "dates": tx.date_mentions("sentence"), "date_starts": tx.mention_starts("sentence", tx.DATES)})
    claim = lambda kind, t, at: F.struct(kind.alias("claim_type"), t.alias("claim"), at.cast("long").alias("start_char"))
    refs = F.transform("refs", lambda t: claim(F.lit("LEGAL_REFERENCE"), t, F.instr("sentence", t) - 1))
    whole = F.array(claim(F.col("kind"), F.col("sentence"), F.lit(0)))
    whole = F.when((F.col("kind") == "LEGAL_REFERENCE") & (F.size("refs") > 0), F.slice(whole, 1, 0)).otherwise(whole)
    dates = F.zip_with("dates", "date_starts", lambda t, at: claim(F.lit("DATE"), t, at))
    found = rows.select("answer_id", "sentence_index", F.col("start_char").alias("from"), F.posexplode(F.concat(refs, whole, dates)).alias("claim_no", "c"))
    start = F.col("from") + F.col("c.start_char")
    return found.select("answer_id", "sentence_index", "claim_no", "c.claim_type", "c.claim", start.alias("start_char"), (start + F.length("c.claim")).alias("end_char"))


def matched(found: DataFrame, evidence: DataFrame, least: float = 0.3) -> DataFrame:
    """Claims joined with the evidence of their answer that supports them: adds evidence_id, match_score, usage."""
    pairs = found.join(evidence.select("answer_id", "evidence_id", F.col("text").alias("evidence")), "answer_id")
    scored = pairs.withColumn("match_score", F.round(tx.match_score("claim", "evidence"), 6)).where(F.col("match_score") >= least)
    return scored.withColumn("usage", tx.usage("match_score")).drop("evidence")


def coverage(found: DataFrame, links: DataFrame) -> DataFrame:
    """Of each answer: claims, supported claims, their share (1 without claims), status."""
    key = ["answer_id", "sentence_index", "claim_no"]
    supported = links.select(*key).distinct().withColumn("supported", F.lit(1))
    out = found.join(supported, key, "left").groupBy("answer_id").agg(F.count("*").alias("n_claims"), F.count("supported").alias("n_supported"))
    share = F.when(F.col("n_claims") == 0, F.lit(1.0)).otherwise(F.col("n_supported") / F.col("n_claims"))
    return out.withColumn("coverage", F.round(share, 6)).withColumn("status", F.when(F.col("n_claims") == F.col("n_supported"), "VALID").otherwise("INVALID"))


def unsupported(found: DataFrame, links: DataFrame) -> DataFrame:
    return found.join(links, ["answer_id", "sentence_index", "claim_no"], "left_anti")


def unused(evidence: DataFrame, links: DataFrame) -> DataFrame:
    return evidence.join(links, ["answer_id", "evidence_id"], "left_anti")


def citations(links: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence that an answer uses, numbered by first use, with a label: anchor's reference, node's reference, document."""
    use = Window.partitionBy("answer_id", "evidence_id").orderBy("sentence_index", "claim_no")
    first = links.withColumn("use", F.row_number().over(use)).where("use = 1")
    joined = first.join(evidence, ["answer_id", "evidence_id"])
    place = F.row_number().over(Window.partitionBy("answer_id").orderBy("sentence_index", "claim_no", "evidence_id"))
    label = F.coalesce("anchor_reference", "node_reference", F.concat(F.lit("Document "), F.col("document_id").cast("string")))
    return joined.select("answer_id", place.alias("citation_no"), "evidence_id", "document_id", label.alias("label"), "usage", "match_score")


def traceability(cited: DataFrame, evidence: DataFrame, versions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds error to citations: the first link of the chain that fails, null where every one holds.

    cited: answer_id, evidence_id, document_id, version_id, node_id; evidence: the same columns as it was found;
    versions: document_id, version_id (a document may have several); nodes: version_id, node_id.
    """
    own = evidence.select("answer_id", "evidence_id", F.struct("document_id", "version_id", "node_id").alias("found")).dropDuplicates(["answer_id", "evidence_id"])
    known = versions.groupBy("document_id").agg(F.lit(True).alias("known_document"))
    of_version = versions.select("document_id", "version_id", F.lit(True).alias("known_version")).distinct()
    of_node = nodes.select("version_id", "node_id", F.lit(True).alias("known_node")).distinct()
    rows = cited.join(own, ["answer_id", "evidence_id"], "left").join(known, "document_id", "left").join(of_version, ["document_id", "version_id"], "left").join(of_node, ["version_id", "node_id"], "left")
    error = (
        F.when(F.col("found").isNull(), "no_matching_evidence")
        .when(~F.col("found").eqNullSafe(F.struct("document_id", "version_id", "node_id")), "disagrees_with_evidence")
        .when(F.col("known_document").isNull(), "missing_document")
        .when(F.col("known_version").isNull(), "missing_version")
        .when(F.col("known_node").isNull(), "missing_node")
    )
    return rows.withColumn("error", error).select(*cited.columns, "error")
