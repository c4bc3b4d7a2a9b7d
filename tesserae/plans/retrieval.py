"""Retrieval queries: questions are the benchmark's passages; entries are lines or documents; vectors are the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text as tx
from tesserae.functions.vectors import test_embedding
from tesserae.operators import registry, retrieval
from tesserae.plans.common import DOCUMENTS, codes_sql, collapse_sql, documents, questions, share_sql, table, terms_sql, tokens_sql
from tesserae.sources.shared import written

K, POOL, DIGITS = 10, 100, 10


def line_entries(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """entry_id (document:line), document_id, ord, content, title, title_tokens of the lines with text; of: only of these documents."""
    d = documents(spark, sf_dir) if of is None else documents(spark, sf_dir).join(of, "document_id", "left_semi")
    d = d.select("document_id", "title", tx.tokens("title").alias("title_tokens"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "content"))
    return d.where(F.trim("content") != "").select(F.concat_ws(":", F.col("document_id").cast("string"), F.col("at").cast("string")).alias("entry_id"), "document_id", F.col("at").alias("ord"), "content", "title", "title_tokens")


def document_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("document_id").alias("entry_id"), "document_id", F.col("text").alias("content"), "title")


def vector_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entry_id"), F.col("embedding").alias("vector"), "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vector"))


def knn(metric: str, **more):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        entries = vector_entries(spark, sf_dir)
        if more.get("labels"):
            entries = registry.filtered(entries, label=more["labels"])
        return retrieval.knn(entries, vector_queries(spark, sf_dir), metric, K, more.get("threshold"))

    return run


_LINES = f"""{DOCUMENTS},
split AS (SELECT document_id, title, string_split(coalesce(text, ''), chr(10)) AS l FROM docs),
entries AS (SELECT document_id || ':' || pos AS entry_id, document_id, pos AS ord, content, title FROM (SELECT document_id, title, unnest(l) AS content, unnest(range(0, len(l))) AS pos FROM split) WHERE trim(content) != '')"""
_QUESTIONS = f"questions AS (SELECT item_id AS query_id, text AS query, {terms_sql('text')} AS terms FROM benchmark)"
_HITS = f"""posted AS (SELECT entry_id, c, t, unnest(list_distinct(list_concat(c, t))) AS term FROM (SELECT entry_id, {tokens_sql('content')} AS c, {tokens_sql('title')} AS t FROM entries)),
asked AS (SELECT query_id, len(terms) AS n_terms, unnest(terms) AS term FROM questions),
met AS (SELECT query_id, entry_id, n_terms, sum(CASE WHEN list_contains(c, term) THEN 1 ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN list_contains(t, term) THEN 1 ELSE 0 END)::DOUBLE AS b FROM posted JOIN asked USING (term) GROUP BY ALL),
hits AS (SELECT query_id, entry_id, round(least(0.85::DOUBLE * (a / n_terms) + 0.15::DOUBLE * (b / n_terms), 1.0::DOUBLE), {DIGITS}) AS score FROM met)"""


def _ranked_sql(source: str, k: int | None, more: str = "") -> str:
    limit = "" if k is None else f"QUALIFY rank <= {k}"
    return f"SELECT query_id, entry_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rank{more} FROM {source} {limit}"


KEYWORD_SQL = f"WITH {_LINES}, {_QUESTIONS}, {_HITS} {_ranked_sql('hits', K)}"


def told_apart(spark: SparkSession, sf_dir: str, k: int) -> int | None:
    """k where no document's id is null or repeated, so that its entries are single rows; else None."""
    ids = table(spark, sf_dir, "documents").groupBy("doc_id").count()
    return None if ids.where("count > 1 or doc_id is null").limit(1).count() else k


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.keyword_hits(line_entries(spark, sf_dir), questions(spark, sf_dir), DIGITS, told_apart(spark, sf_dir, K))
    return retrieval.ranked(hits, ["query_id"], [F.desc("score"), F.asc("entry_id")], K).select("query_id", "entry_id", "score", "rank")


def _knn_sql(metric: str, threshold: float | None = None, labels=None) -> str:
    a, b = "e.embedding::DOUBLE[]", "q.embedding::DOUBLE[]"
    score = {"cosine": f"list_cosine_similarity({a}, {b})", "dot": f"list_inner_product({a}, {b})", "euclid": f"1 / (1 + list_distance({a}, {b}))"}[metric]
    where = f"AND e.label IN ({', '.join(map(str, labels))})" if labels else ""
    cut = f"WHERE raw >= {threshold}" if threshold is not None else ""
    return f"""WITH scored AS (SELECT q.vec_id AS query_id, e.vec_id AS entry_id, {score} AS raw FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 {where}),
kept AS (SELECT query_id, entry_id, round(raw, 6) AS score FROM scored {cut}) {_ranked_sql('kept', K)}"""


def semantic_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stand for the documents and questions of their ids; scores are (cosine + 1) / 2, rounded."""
    v = table(spark, sf_dir, "embeddings")
    entries = v.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("entry_id"), F.col("embedding").alias("vector"))
    asked = questions(spark, sf_dir).join(v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vector")), "query_id").select("query_id", "q_vector")
    raw = retrieval.knn(entries, asked, "cosine", POOL, digits=12)
    scored = raw.select("query_id", "entry_id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("score") + 1) / 2)), 4).alias("score"))
    return retrieval.ranked(scored, ["query_id"], [F.desc("score"), F.asc("entry_id")])


def keyword_pool(spark: SparkSession, sf_dir: str, k: int = POOL) -> DataFrame:
    hits = retrieval.keyword_hits(document_entries(spark, sf_dir), questions(spark, sf_dir), DIGITS, told_apart(spark, sf_dir, k))
    return retrieval.ranked(hits, ["query_id"], [F.desc("score"), F.asc("entry_id")], k)


def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = questions(spark, sf_dir).select("query_id", tx.document_codes("query").alias("codes"))
    titled = documents(spark, sf_dir).select(F.col("document_id").alias("entry_id"), "title")

    def with_ratio(pairs: DataFrame) -> DataFrame:
        return pairs.join(coded, "query_id").join(titled, "entry_id").withColumn("ratio", tx.share(tx.tokens("title"), F.col("codes"))).drop("codes", "title")

    return retrieval.fuse(semantic_pool(spark, sf_dir), keyword_pool(spark, sf_dir), with_ratio, K).select("query_id", "entry_id", "score", "rank")


_FUSED = f"""{DOCUMENTS}, entries AS (SELECT document_id AS entry_id, text AS content, title FROM docs), {_QUESTIONS}, {_HITS},
cos AS (SELECT q.query_id, e.vec_id AS entry_id, round(list_cosine_similarity(e.embedding::DOUBLE[], v.embedding::DOUBLE[]), 12) AS c FROM questions q JOIN embeddings v ON v.vec_id = q.query_id, embeddings e WHERE e.vec_id IN (SELECT document_id FROM docs)),
pool AS (SELECT query_id, entry_id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (c + 1) / 2)), 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, entry_id) AS r FROM cos) WHERE r <= {POOL}),
s AS (SELECT query_id, entry_id, score AS s, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS s_rank FROM pool),
w AS (SELECT query_id, entry_id, score AS w, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS w_rank FROM hits QUALIFY w_rank <= {POOL}),
mixed AS (SELECT query_id, entry_id, coalesce(s, 0) AS s, coalesce(w, 0) AS w, least(1.0::DOUBLE, (coalesce(1 / (60 + s_rank::DOUBLE), 0) + coalesce(1 / (60 + w_rank::DOUBLE), 0)) / (2.0::DOUBLE / 61)) AS rrf, max(s IS NOT NULL) OVER (PARTITION BY query_id) AS any_s, max(w IS NOT NULL) OVER (PARTITION BY query_id) AS any_w FROM s FULL OUTER JOIN w USING (query_id, entry_id)),
coded AS (SELECT m.*, {share_sql(tokens_sql('d.title'), codes_sql('q.query'))} AS ratio FROM mixed m JOIN questions q USING (query_id) JOIN docs d ON d.document_id = m.entry_id),
fusing AS (SELECT query_id, entry_id, CASE WHEN NOT any_w THEN s WHEN NOT any_s THEN w ELSE round(least(1.0::DOUBLE, (CASE WHEN s != 0 AND w != 0 THEN 0.75::DOUBLE * s + 0.15::DOUBLE * w + 0.10::DOUBLE * rrf WHEN s != 0 THEN 0.95::DOUBLE * s + (1 - 0.95::DOUBLE) * rrf ELSE 0.95::DOUBLE * w + (1 - 0.95::DOUBLE) * rrf END) + 0.08::DOUBLE * ratio), 4) END AS score FROM coded),
fused AS ({_ranked_sql('fusing', K)})"""


def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.split("entry_id", ":")
    hits = keyword_search(spark, sf_dir).select("query_id", "entry_id", place[0].cast("long").alias("document_id"), place[1].cast("int").alias("ord"), "score")
    hits = written(hits, "hits")  # few rows, used twice below: the search itself runs once
    chunks = line_entries(spark, sf_dir, hits.select("document_id").distinct()).select("entry_id", "document_id", "ord")
    return retrieval.context_window(chunks, hits, 1)


CONTEXT_SQL = f"""WITH {_LINES}, {_QUESTIONS}, {_HITS}, top AS ({_ranked_sql('hits', K)}),
placed AS (SELECT query_id, document_id, ord AS hit, score FROM top JOIN entries USING (entry_id)),
near AS (SELECT query_id, e.entry_id, a.score FROM placed a JOIN entries e ON e.document_id = a.document_id AND abs(e.ord - a.hit) <= 1)
SELECT query_id, entry_id, round(max(score) * 0.8::DOUBLE, 6) AS score FROM near WHERE (query_id, entry_id) NOT IN (SELECT query_id, entry_id FROM top) GROUP BY ALL"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused hits as evidence: every second document has a reference."""
    d = documents(spark, sf_dir)
    rows = hybrid_fusion(spark, sf_dir).join(questions(spark, sf_dir), "query_id").join(d.select(F.col("document_id").alias("entry_id"), "text", "title"), "entry_id")
    reference = F.when(F.col("entry_id") % 2 == 0, F.concat(F.lit("Điều "), F.col("entry_id").cast("string")))
    return rows.select("query_id", "query", F.col("entry_id").alias("evidence_id"), F.col("entry_id").alias("document_id"), F.col("entry_id").alias("node_id"), "text", "title", reference.alias("reference"), "score")


_EVIDENCE = f"""{_FUSED},
evidence AS (SELECT f.query_id, q.query, q.terms, f.entry_id AS evidence_id, d.text, d.title, CASE WHEN f.entry_id % 2 = 0 THEN 'Điều ' || f.entry_id END AS reference, f.score FROM fused f JOIN questions q USING (query_id) JOIN docs d ON d.document_id = f.entry_id)"""


def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.rerank(evidence(spark, sf_dir)).select("query_id", "evidence_id", "combined", "rank", "reason")


_RERANKED = f"""{_EVIDENCE},
combined AS (SELECT *, round(score * (1.0::DOUBLE - 0.0 - 0.1::DOUBLE - 0.1::DOUBLE) + 0.1::DOUBLE + (CASE WHEN reference IS NOT NULL THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END) * 0.1::DOUBLE, 4) AS combined FROM evidence WHERE score >= 0.2),
reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, evidence_id) AS rank FROM combined QUALIFY rank <= 8)"""
RERANK_SQL = f"WITH {_RERANKED} SELECT query_id, evidence_id, combined, rank, CASE WHEN rank = 1 THEN 'top_relevance' WHEN reference IS NOT NULL THEN 'cited_authority' ELSE 'relevance' END AS reason FROM reranked"


def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First entry of each equal line, case and blanks aside."""
    rows = line_entries(spark, sf_dir).withColumn("same", tx.collapse(F.lower("content")))
    return retrieval.ranked(rows, ["same"], [F.asc("entry_id")], 1, "copy").select("entry_id", F.length("same").cast("long").alias("n_chars"))


DEDUPE_SQL = f"WITH {_LINES} SELECT min(entry_id) AS entry_id, length(same)::BIGINT AS n_chars FROM (SELECT entry_id, {collapse_sql('lower(content)')} AS same FROM entries) GROUP BY same"


def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.evidence_gate(evidence(spark, sf_dir), floor=0.3, strong=0.6).select("query_id", "evidence_id", "score")


_GATED = f"""{_EVIDENCE},
gated AS (SELECT * FROM evidence WHERE score >= 0.3::DOUBLE AND (len(terms) = 0 OR score >= 0.6::DOUBLE OR len(list_intersect({codes_sql('query')}, {tokens_sql('title')})) > 0 OR {share_sql(tokens_sql("text || ' ' || title"), 'terms')} >= 0.35::DOUBLE))"""


def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = retrieval.evidence_gate(evidence(spark, sf_dir), floor=0.3, strong=0.6)
    rows = questions(spark, sf_dir).select("query_id").join(gated.select("query_id", "score"), "query_id", "left")
    return retrieval.confidence(rows, ["query_id"], 9)


CONFIDENCE_SQL = f"""WITH {_GATED}, c AS (SELECT q.query_id, avg(g.score) AS mean, count(g.score) AS n FROM questions q LEFT JOIN gated g USING (query_id) GROUP BY ALL)
SELECT query_id, CASE WHEN n = 0 THEN 'LOW' WHEN mean >= 0.8 AND n >= 2 THEN 'HIGH' WHEN mean >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS level, round(coalesce(mean, 0), 9) AS score, n AS n_evidence FROM c"""


def answer_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = retrieval.rerank(evidence(spark, sf_dir)).select("query_id", "rank", "text", F.col("reference").alias("label"))
    return retrieval.template_answer(top).select("query_id", F.sha2("content", 256).alias("content_sha256"), F.length("content").cast("long").alias("n_chars"))


ANSWER_SQL = f"""WITH {_RERANKED},
answers AS (SELECT query_id, '## Kết quả tra cứu' || chr(10) || chr(10) || '### Thông tin tìm thấy' || chr(10) || chr(10) || string_agg(text || chr(10), chr(10) ORDER BY rank) || chr(10) || '### Trích dẫn' || chr(10) || chr(10) || string_agg('- **' || coalesce(reference, 'Nguồn ' || rank) || '**', chr(10) ORDER BY rank) || chr(10) AS content FROM reranked WHERE coalesce(text, '') != '' GROUP BY query_id)
SELECT query_id, sha256(content) AS content_sha256, length(content)::BIGINT AS n_chars FROM answers"""


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir)
    return q.select("query_id", F.explode(tx.query_terms("query")).alias("term"))


def doc_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("document_id", F.explode(tx.document_codes("text")).alias("code"))


def test_embedder(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = test_embedding(F.col("query"))
    return questions(spark, sf_dir).select("query_id", F.size(v).cast("long").alias("dimension"), F.round(F.get(v, 0), 9).alias("first"), F.round(F.aggregate(v, F.lit(0.0), lambda z, x: z + x * x), 6).alias("norm"))


def _embedder_sql() -> str:
    chain = ", ".join(f"s{i} AS (SELECT *, sha256(unhex(h{i - 1})) AS h{i} FROM s{i - 1})" for i in range(1, 13))
    digits = " || ".join(f"h{i}" for i in range(1, 13))
    byte = "(('0x' || substring(d, (2 * i + 1)::BIGINT, 2))::INTEGER / 127.5::DOUBLE - 1)"
    return f"""WITH s0 AS (SELECT item_id AS query_id, sha256(text) AS h0 FROM benchmark), {chain}, raw AS (SELECT query_id, {digits} AS d FROM s12), v AS (SELECT query_id, [{byte} FOR i IN range(0, 384)] AS v FROM raw)
SELECT query_id, len(v)::BIGINT AS dimension, round(v[1] / sqrt(list_inner_product(v, v)), 9) AS first, 1.0::DOUBLE AS norm FROM v"""


QUERIES = {
    "keyword_search": keyword_search,
    "knn_cosine": knn("cosine"),
    "knn_dot": knn("dot"),
    "knn_euclid": knn("euclid"),
    "knn_threshold": knn("cosine", threshold=0.3),
    "knn_filtered": knn("cosine", labels=[1, 3, 5]),
    "hybrid_fusion": hybrid_fusion,
    "context_window": context_window,
    "rerank": rerank,
    "dedupe_first": dedupe_first,
    "evidence_gate": evidence_gate,
    "confidence": confidence,
    "answer_template": answer_template,
    "query_terms": query_terms,
    "doc_codes": doc_codes,
    "test_embedder": test_embedder,
}
SQL = {
    "keyword_search": KEYWORD_SQL,
    "knn_cosine": _knn_sql("cosine"),
    "knn_dot": _knn_sql("dot"),
    "knn_euclid": _knn_sql("euclid"),
    "knn_threshold": _knn_sql("cosine", 0.3),
    "knn_filtered": _knn_sql("cosine", None, [1, 3, 5]),
    "hybrid_fusion": f"WITH {_FUSED} SELECT * FROM fused",
    "context_window": CONTEXT_SQL,
    "rerank": RERANK_SQL,
    "dedupe_first": DEDUPE_SQL,
    "evidence_gate": f"WITH {_GATED} SELECT query_id, evidence_id, score FROM gated",
    "confidence": CONFIDENCE_SQL,
    "answer_template": ANSWER_SQL,
    "query_terms": f"SELECT item_id AS query_id, unnest({terms_sql('text')}) AS term FROM benchmark",
    "doc_codes": f"SELECT doc_id AS document_id, unnest({codes_sql('text')}) AS code FROM documents",
    "test_embedder": _embedder_sql(),
}
