"""Retrieval: exact vector search, keyword search, fusion, context, reranking, evidence gate, answers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import text as tx
from tesserae.operators import keywords, nearest

#: Bytes up to which a query side is broadcast; beyond, the join shuffles. The sizes are Spark's own estimates.
BROADCAST_BYTES = 64 << 20
#: Tasks that share the postings of one term.
SALTS = 16


def is_small(df: DataFrame) -> bool:
    """Whether the optimizer's estimate of a side is small enough to broadcast."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES


def maybe_broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if is_small(df) else df


def ranked(df: DataFrame, keys: list[str], order: list[Column], k: int | None = None, name: str = "rank") -> DataFrame:
    """Ranks from 1 by order; with k, only the first k (Spark then limits each group before the shuffle)."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = out if k is None else out.where(F.col(name) <= k)
    return kept.withColumn(name, F.col(name).cast("long"))


def knn(entries: DataFrame, queries: DataFrame, metric: str = "cosine", k: int = 10, threshold: float | None = None, digits: int = 6) -> DataFrame:
    """Exact k nearest entries of each query: query_id, entry_id, score, rank.

    entries: entry_id, vector and filter columns that the caller has applied; queries: query_id, q_vector. Every query
    meets every entry of its length, in blocks; ranks are by rounded scores, the threshold is for the score as it is. A small query side is
    broadcast; beyond, entries are dealt into slices and each slice gets the queries, so that no key gathers all rows.
    """
    if metric not in nearest.METRICS:
        raise ValueError(f"unknown metric: {metric}")
    found = nearest.candidates(entries.select("entry_id", "vector"), queries.select("query_id", "q_vector"), metric, k, threshold, digits, is_small(queries.select("query_id", "q_vector")))
    return ranked(found.withColumn("score", F.round("score", digits)), ["query_id"], [F.desc("score"), F.asc("entry_id")], k)


def keyword_hits(entries: DataFrame, queries: DataFrame, digits: int = 6, k: int | None = None) -> DataFrame:
    """query_id, entry_id, score > 0: .85 of the query's terms in the content, .15 in the title.

    entries: entry_id, content, title, and optionally title_tokens; queries: query_id, query. Terms meet by an inverted
    index: entry terms are exploded and joined by equality, so nothing is compared that shares no term. With k, for entries
    whose ids are neither null nor repeated, only the first k of each query need be found: if the queries are small,
    tasks count and leave out the others, as nearly every entry shares some term with nearly every query.
    """
    asked = queries.select("query_id", tx.query_terms("query").alias("terms")).where(F.size("terms") > 0)
    score = F.round(F.least(0.85 * (F.col("a") / F.col("n_terms")) + 0.15 * (F.col("b") / F.col("n_terms")), F.lit(1.0)), digits).alias("score")
    # Other counts mustn't round to the same score, or ties would go otherwise.
    if k is not None and digits >= 8 and is_small(queries):
        titles = F.col("title_tokens") if "title_tokens" in entries.columns else tx.tokens("title")
        met = keywords.best(entries.select("entry_id", tx.tokens("content").alias("content"), titles.alias("title")), asked, k)
        return met.select("query_id", "entry_id", score).where("score > 0")
    asked = asked.select("query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    # Content and title are posted apart: a term carries two counts instead of the arrays that it came from.
    post = lambda c, content: F.transform(tx.tokens(c), lambda t: F.struct(t.alias("term"), F.lit(int(content)).alias("in_content"), F.lit(int(not content)).alias("in_title")))
    posted = entries.select("entry_id", F.explode(F.concat(post("content", True), post("title", False))).alias("p")).select("entry_id", "p.*")
    if is_small(asked):
        pairs = posted.join(F.broadcast(asked), "term")
    else:  # a frequent term's postings are dealt to several tasks, each with the queries that ask for it
        salted = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = posted.withColumn("salt", F.pmod(F.xxhash64("entry_id"), F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"])
    met = pairs.groupBy("query_id", "entry_id").agg(F.any_value("n_terms").alias("n_terms"), F.sum("in_content").alias("a"), F.sum("in_title").alias("b"))
    return met.select("query_id", "entry_id", score).where("score > 0")


@dataclass(frozen=True)
class Fusion:
    """Weights of the fused score."""

    semantic: float = 0.75
    keyword: float = 0.15
    rank: float = 0.10
    alone: float = 0.95
    offset: float = 60.0
    code: float = 0.08


def fuse(semantic: DataFrame, keyword: DataFrame, with_ratio: Callable[[DataFrame], DataFrame] | None = None, k: int | None = None, weights: Fusion = Fusion()) -> DataFrame:
    """Fused score and rank of two ranked lists (query_id, entry_id, score, rank each).

    A query that one list is empty for gets the other list as it is. with_ratio adds ratio (of the query's document codes
    that the entry has) to the joined pairs, so that the lists are made once.
    """
    s = semantic.select("query_id", "entry_id", F.col("score").alias("s"), F.col("rank").alias("s_rank"))
    w = keyword.select("query_id", "entry_id", F.col("score").alias("w"), F.col("rank").alias("w_rank"))
    both = s.join(w, ["query_id", "entry_id"], "full_outer")
    both = both.withColumn("ratio", F.lit(0.0)) if with_ratio is None else with_ratio(both)
    own = Window.partitionBy("query_id")
    both = both.withColumn("any_s", F.max(F.col("s").isNotNull()).over(own)).withColumn("any_w", F.max(F.col("w").isNotNull()).over(own))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    part = lambda c: F.coalesce(1 / (weights.offset + F.col(c)), F.lit(0.0))
    rrf = F.least(F.lit(1.0), (part("s_rank") + part("w_rank")) / F.lit(2 / (weights.offset + 1)))
    fused = (
        F.when((zero("s") != 0) & (zero("w") != 0), weights.semantic * zero("s") + weights.keyword * zero("w") + weights.rank * rrf)
        .when(zero("s") != 0, weights.alone * zero("s") + (1 - weights.alone) * rrf)
        .otherwise(weights.alone * zero("w") + (1 - weights.alone) * rrf)
    )
    fused = F.round(F.least(F.lit(1.0), fused + weights.code * zero("ratio")), 4)
    score = F.when(~F.col("any_w"), F.col("s")).when(~F.col("any_s"), F.col("w")).otherwise(fused)
    return ranked(both.select("query_id", "entry_id", score.alias("score")), ["query_id"], [F.desc("score"), F.asc("entry_id")], k)


def context_window(chunks: DataFrame, hits: DataFrame, width: int = 1, factor: float = 0.8) -> DataFrame:
    """Neighbours of the hits in document order, each once, at a share of the score; hits themselves are left out.

    chunks: document_id, ord, entry_id; hits: query_id, document_id, ord, score. A hit marks itself among its
    neighbours, so no second look at the hits is needed.
    """
    step = F.explode(F.sequence(F.lit(-width), F.lit(width)))
    near = hits.select("query_id", "document_id", "ord", "score", step.alias("step")).select("query_id", "document_id", (F.col("ord") + F.col("step")).alias("ord"), "score", (F.col("step") == 0).alias("hit"))
    once = near.groupBy("query_id", "document_id", "ord").agg(F.max("score").alias("score"), F.max("hit").alias("hit")).where("not hit")
    return once.join(chunks, ["document_id", "ord"]).select("query_id", "entry_id", F.round(F.col("score") * factor, 6).alias("score"))


@dataclass(frozen=True)
class Rerank:
    floor: float = 0.2
    lexical: float = 0.0
    freshness: float = 0.1
    authority: float = 0.1
    cited: float = 1.1
    budget: int = 8


def rerank(evidence: DataFrame, config: Rerank = Rerank()) -> DataFrame:
    """Combined scores, the first of equal sources, the best of each query.

    evidence: query_id, evidence_id, document_id, node_id, text, query, reference (or null), score.
    """
    alignment = tx.share(tx.tokens("text"), tx.tokens("query"))
    authority = F.when(F.col("reference").isNotNull(), F.lit(config.cited)).otherwise(F.lit(1.0))
    combined = F.col("score") * (1.0 - config.lexical - config.freshness - config.authority) + alignment * config.lexical + config.freshness + authority * config.authority
    kept = evidence.where(F.col("score") >= config.floor).withColumn("combined", F.round(combined, 4)).withColumn("same", tx.collapse(F.lower("text")))
    order = [F.desc("combined"), F.asc("evidence_id")]
    once = ranked(kept, ["query_id", "document_id", "node_id", "same"], order, 1, "copy").drop("copy", "same")
    reason = F.when(F.col("rank") == 1, "top_relevance").when(F.col("reference").isNotNull(), "cited_authority").otherwise("relevance")
    return ranked(once, ["query_id"], order, config.budget).withColumn("reason", reason)


def evidence_gate(evidence: DataFrame, floor: float = 0.72, strong: float = 0.80, coverage: float = 0.35) -> DataFrame:
    """Evidence strong and specific enough for an answer. evidence: query, text, title (or null), score, ..."""
    terms, codes = tx.query_terms("query"), tx.document_codes("query")
    title = F.coalesce(F.col("title"), F.lit(""))
    named = F.size(F.array_intersect(codes, tx.tokens(title))) > 0
    covered = tx.share(tx.tokens(F.concat_ws(" ", "text", "title")), terms) >= coverage
    return evidence.where((F.col("score") >= floor) & ((F.size(terms) == 0) | (F.col("score") >= strong) | named | covered))


def confidence(evidence: DataFrame, keys: list[str], digits: int = 4) -> DataFrame:
    """Level and mean score of each key's evidence; keys without any come with a null score."""
    out = evidence.groupBy(*keys).agg(F.avg("score").alias("mean"), F.count("score").alias("n_evidence"))
    level = F.when(F.col("n_evidence") == 0, "LOW").when((F.col("mean") >= 0.8) & (F.col("n_evidence") >= 2), "HIGH").when(F.col("mean") >= 0.5, "MEDIUM").otherwise("LOW")
    return out.select(*keys, level.alias("level"), F.round(F.coalesce("mean", F.lit(0.0)), digits).alias("score"), "n_evidence")


#: Headings of the template answer.
NOTHING, HEAD, FOUND, CITED = "Không có thông tin để hiển thị.", "## Kết quả tra cứu\n", "### Thông tin tìm thấy\n", "### Trích dẫn\n"


def template_answer(evidence: DataFrame) -> DataFrame:
    """One markdown answer for each query. evidence: query_id, rank, text, label."""
    filled = F.filter(F.array_sort(F.collect_list(F.struct("rank", "text", "label"))), lambda x: F.coalesce(x["text"], F.lit("")) != "")
    rows = evidence.groupBy("query_id").agg(filled.alias("e"))
    bodies = F.transform("e", lambda x: F.concat(x["text"], F.lit("\n")))
    labels = F.transform("e", lambda x: F.concat(F.lit("- **"), F.coalesce(x["label"], F.concat(F.lit("Nguồn "), x["rank"].cast("string"))), F.lit("**")))
    whole = F.array_join(F.concat(tx.strings([HEAD, FOUND]), bodies, tx.strings([CITED]), labels, tx.strings([""])), "\n")
    return rows.select("query_id", F.when(F.size("e") == 0, F.lit(NOTHING)).otherwise(whole).alias("content"))
