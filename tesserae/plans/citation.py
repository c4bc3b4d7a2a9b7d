"""Claim, citation and evaluation queries: answers are the assistant's turns, evidence is the other turns of a conversation.

Every fourth conversation's answers open with a fixed sentence that holds references and a date, as the driver's texts
hold none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text as tx
from tesserae.operators import citation, evaluation
from tesserae.operators.passages import WORD, within
from tesserae.operators.retrieval import is_small, maybe_broadcast
from tesserae.plans import retrieval as pr
from tesserae.plans.common import DOCUMENTS, collapse_sql, documents, listed, questions, strip_sql, table

OPENING = "Theo Điều 3 Khoản 2 Điểm a và Mục 4, văn bản này áp dụng từ ngày 1 tháng 2 năm 2024 đến 03/04/2025. "


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    content = F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit(OPENING), "text")).otherwise(F.col("text"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "conv_id", content.alias("content"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of an answer: the other roles' turns of its conversation."""
    c = table(spark, sf_dir, "conversations").where("role != 'assistant'").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("evidence_id"), "text")
    return answers(spark, sf_dir).select("answer_id", "conv_id").join(c, "conv_id").select("answer_id", "evidence_id", "text")


_MARK = "chr(30)"
_ANSWERS = f"""answers AS (SELECT conv_id * 1000 + turn AS answer_id, conv_id, CASE WHEN conv_id % 4 = 0 THEN '{OPENING}' ELSE '' END || text AS content FROM conversations WHERE role = 'assistant'),
evidence AS (SELECT a.answer_id, c.conv_id * 1000 + c.turn AS evidence_id, c.text FROM answers a JOIN conversations c USING (conv_id) WHERE c.role != 'assistant')"""
_SENTENCES = f"""{_ANSWERS},
first_cut AS (SELECT answer_id, string_split(regexp_replace(content, '([.!?])\\s+([{tx.SENTENCE_START}])', '\\1' || {_MARK} || '\\2', 'g'), {_MARK}) AS f, string_split(regexp_replace(content, '([.!?])\\s+', '\\1' || {_MARK}, 'g'), {_MARK}) AS g FROM answers),
pieces AS (SELECT answer_id, [{strip_sql('s')} FOR s IN (CASE WHEN len(f) <= 1 THEN g ELSE f END) IF {strip_sql('s')} != ''] AS p FROM first_cut),
said AS (SELECT answer_id, unnest(p) AS sentence, unnest(range(0, len(p)))::INTEGER AS sentence_index FROM pieces),
sentences AS (SELECT *, coalesce(sum(length(sentence) + 1) OVER (PARTITION BY answer_id ORDER BY sentence_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_char FROM said)"""
_KIND = (
    f"CASE WHEN regexp_matches(sentence, '{tx.REFERENCE_TEST}') THEN 'LEGAL_REFERENCE' "
    + " ".join("WHEN " + " OR ".join(f"contains(lower(sentence), '{w}')" for w in words) + f" THEN '{name}'" for name, words in tx.KEYWORDS)
    + f" WHEN regexp_matches(sentence, '{tx.DATE_TEST}') THEN 'DATE' ELSE 'STATEMENT_OF_FACT' END"
)


def _all(patterns) -> str:
    out = f"regexp_extract_all(sentence, '{patterns[0]}')"
    for p in patterns[1:]:
        out = f"list_concat({out}, regexp_extract_all(sentence, '{p}'))"
    return out


def _dated(pattern: str) -> str:
    """Matches of a pattern with the place where each starts in its sentence."""
    found, between = f"regexp_extract_all(sentence, '{pattern}')", f"string_split(regexp_replace(sentence, '{pattern}', {_MARK}, 'g'), {_MARK})"
    return f"[{{'t': 'DATE', 'c': {found}[i], 's': (list_sum([length(x) FOR x IN {between}[1 : i]]) + coalesce(list_sum([length(x) FOR x IN {found}[1 : i - 1]]), 0))::BIGINT}} FOR i IN range(1, len({found}) + 1)]"


_CLAIMS = f"""{_SENTENCES},
kinds AS (SELECT *, {_KIND} AS kind, {_all(tx.REFERENCES)} AS refs FROM sentences WHERE sentence_index < 5),
mixed AS (SELECT answer_id, sentence_index, start_char, list_concat(list_concat(list_concat([{{'t': 'LEGAL_REFERENCE', 'c': r, 's': instr(sentence, r) - 1}} FOR r IN refs], CASE WHEN kind = 'LEGAL_REFERENCE' AND len(refs) > 0 THEN [] ELSE [{{'t': kind, 'c': sentence, 's': 0}}] END), {_dated(tx.DATES[0])}), {_dated(tx.DATES[1])}) AS m FROM kinds),
claims AS (SELECT answer_id, sentence_index, claim_no, x.t AS claim_type, x.c AS claim, start_char + x.s AS start_char, start_char + x.s + length(x.c) AS end_char FROM (SELECT answer_id, sentence_index, start_char, unnest(m) AS x, unnest(range(0, len(m)))::INTEGER AS claim_no FROM mixed))"""


def _words(x: str) -> str:
    return f"[w FOR w IN list_distinct(string_split({collapse_sql(x)}, ' ')) IF w != '' AND NOT list_contains({listed(tx.CLAIM_STOPWORDS)}, w)]"


_LINKS = f"""{_CLAIMS},
pairs AS (SELECT c.*, e.evidence_id, lower(c.claim) AS a, lower(e.text) AS b FROM claims c JOIN evidence e USING (answer_id)),
scored AS (SELECT answer_id, sentence_index, claim_no, claim_type, claim, evidence_id, CASE WHEN a = '' OR b = '' THEN 0 WHEN a = b THEN 1 WHEN contains(b, a) THEN 0.9::DOUBLE WHEN contains(a, b) THEN 0.8::DOUBLE WHEN len({_words('a')}) = 0 THEN 0 ELSE len(list_intersect({_words('a')}, {_words('b')}))::DOUBLE / len({_words('a')}) END AS s FROM pairs),
links AS (SELECT * EXCLUDE (s), round(s, 6) AS match_score, CASE WHEN round(s, 6) >= 0.8 THEN 'DIRECT' WHEN round(s, 6) >= 0.5 THEN 'SUPPORTING' ELSE 'CONTEXT' END AS usage FROM scored WHERE round(s, 6) >= 0.3)"""


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citation.sentences(answers(spark, sf_dir))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citation.claims(answers(spark, sf_dir))


def claim_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir).groupBy("claim_type").agg(F.count("*").alias("n"), F.count_distinct("answer_id").alias("n_answers"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citation.matched(claims(spark, sf_dir), evidence(spark, sf_dir))


def claim_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir).select("answer_id", "sentence_index", "claim_no", "evidence_id", "match_score", "usage")


def citation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citation.coverage(claims(spark, sf_dir), links(spark, sf_dir))


def unused_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citation.unused(evidence(spark, sf_dir), links(spark, sf_dir)).select("answer_id", "evidence_id")


def unsupported_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citation.unsupported(claims(spark, sf_dir), links(spark, sf_dir)).groupBy("answer_id").agg(F.count("*").alias("n_unsupported"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evidence(spark, sf_dir)
    anchors = e.select("answer_id", "evidence_id", F.col("evidence_id").alias("document_id"), F.when(F.col("evidence_id") % 3 == 0, F.concat(F.lit("Điều "), F.col("evidence_id").cast("string"))).alias("anchor_reference"), F.when(F.col("evidence_id") % 3 == 1, F.lit("Khoản 1")).alias("node_reference"))
    return citation.citations(links(spark, sf_dir), anchors).select("answer_id", "citation_no", "evidence_id", "label", "usage")


def traceability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of made-up anchors: documents have two versions; some citations lack or contradict evidence, or name what doesn't exist."""
    e, a = F.col("evidence_id"), F.col("answer_id")
    document, version = e % 1300, lambda shift: F.concat(F.lit("v"), (e % 1300).cast("string"), F.lit("."), ((e + shift) % 3).cast("string"))
    anchored = evidence(spark, sf_dir).select("answer_id", "evidence_id", document.alias("document_id"), version(0).alias("version_id"), (e % 8).alias("node_id"))
    cited = anchored.withColumn("node_id", F.when((e + a) % 13 == 0, F.col("node_id") + 1).otherwise(F.col("node_id")))
    d = documents(spark, sf_dir).select("document_id")
    versions = d.select("document_id", F.explode(F.array(*[F.concat(F.lit("v"), F.col("document_id").cast("string"), F.lit(f".{i}")) for i in (0, 1)])).alias("version_id"))
    nodes = versions.select("version_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("node_id"))
    return citation.traceability(cited, anchored.where((e + a) % 11 != 0), versions, nodes)


# --- evaluation ----------------------------------------------------------------------------------------------


#: Words of a passage that a text must hold in a row to be compared with it.
GRAM = 5


def _grams(words):
    """Hashes of all runs of GRAM words, in linear time: words are bound to a variable, else each run would work them out anew."""

    def hashes(w):
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - GRAM), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(GRAM)]))
        return F.when(F.size(w) >= GRAM, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(words), hashes), 0)


def holding(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id, document_id: the texts that hold a passage. texts: document_id, text; passages: query_id, query.

    Passages of a size that may be broadcast are looked for in one pass over the texts' bytes, those of a few bytes apart. Others go by words:
    a text that holds a passage has the passage's inner words in a row: the first GRAM of them, hashed, meet the texts' runs
    of GRAM words by equality, and what meets is compared. Passages of fewer words are compared with all texts.
    """
    if is_small(passages):
        asked = passages.where("query is not null")
        long = F.octet_length("query") >= WORD
        short = texts.join(F.broadcast(asked.where(~long)), F.contains("text", "query")).select("query_id", "document_id")
        return within(texts, asked.where(long)).unionByName(short).distinct()
    inner = F.split(F.trim("query"), r"\s+")
    asked = passages.where("query is not null").withColumn("inner", F.slice(inner, F.lit(2), F.greatest(F.size(inner) - 2, F.lit(0))))
    long = asked.where(F.size("inner") >= GRAM).select("query_id", "query", F.xxhash64(*[F.get("inner", F.lit(k)) for k in range(GRAM)]).alias("gram"))
    # Texts stay out of the exploded rows, which would each hold a copy; what meets fetches its text once.
    runs = texts.select("document_id", F.explode(_grams(F.split("text", r"\s+"))).alias("gram"))
    near = runs.join(maybe_broadcast(long.select("query_id", "gram")), "gram").select("query_id", "document_id").distinct()
    met = near.join(texts, "document_id").join(long.select("query_id", "query"), "query_id").where(F.contains("text", "query")).select("query_id", "document_id")
    short = texts.join(maybe_broadcast(asked.where(F.size("inner") < GRAM).select("query_id", "query")), F.contains("text", "query")).select("query_id", "document_id")
    return met.unionByName(short).distinct()


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a question's passage."""
    return holding(documents(spark, sf_dir).select("document_id", "text"), questions(spark, sf_dir)).select("query_id", F.col("document_id").alias("item"))


def retrieved(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """The first k of each question's pool, so that tasks needn't keep the rest."""
    return pr.keyword_pool(spark, sf_dir, min(k, pr.POOL)).select("query_id", F.col("entry_id").alias("item"), "rank")


def recall_precision(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return evaluation.at_k(expected(spark, sf_dir), retrieved(spark, sf_dir, k), k)


def mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.mean_reciprocal_rank(recall_precision(spark, sf_dir))


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item"), "quality")
    hit = expected(spark, sf_dir).withColumn("hit", F.lit(2))
    rows = retrieved(spark, sf_dir).where("rank <= 10").join(quality, "item", "left").join(hit, ["query_id", "item"], "left")
    return rows.select("query_id", "rank", (F.coalesce("hit", F.lit(0)) + F.coalesce("quality", F.lit(0))).cast("double").alias("relevance"))


def ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.ndcg(graded(spark, sf_dir), 10)


def citation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cov = citation_coverage(spark, sf_dir)
    return evaluation.citation_scores(cov.select("answer_id", F.col("n_claims").alias("generated"), (F.col("n_claims") % 3).alias("expected"), F.least("n_supported", F.col("n_claims") % 3).alias("correct")))


def report(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return evaluation.report(evaluation.verdicts(recall_precision(spark, sf_dir, k)))


def regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report at 10 against the report at 3, from one join of what is expected and found."""
    rows = evaluation.at_cutoffs(expected(spark, sf_dir), retrieved(spark, sf_dir), (3, 10))
    both = evaluation.report(evaluation.verdicts(rows), by=("k",))
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    return evaluation.compared(both.groupBy("component", "metric").agg(at(3).alias("baseline"), at(10).alias("value")))


_POOL = f"""{DOCUMENTS}, entries AS (SELECT document_id AS entry_id, text AS content, title FROM docs), {pr._QUESTIONS}, {pr._HITS},
retrieved AS (SELECT query_id, entry_id AS item, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rank FROM hits QUALIFY rank <= {pr.POOL}),
expected AS (SELECT DISTINCT query_id, document_id AS item FROM questions JOIN docs ON contains(docs.text, questions.query))"""


def _at(k: int) -> str:
    return f"""at{k} AS (SELECT query_id, total, hits, round(r, 6) AS recall, round(p, 6) AS precision, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1, round(coalesce(1.0::DOUBLE / first_hit, 0), 6) AS reciprocal_rank FROM
(SELECT *, CASE WHEN total = 0 THEN 1.0::DOUBLE ELSE least(hits::DOUBLE / total, 1.0) END AS r, hits::DOUBLE / {k} AS p FROM
(SELECT query_id, count(e.item) AS total, count(*) FILTER (e.item IS NOT NULL AND t.item IS NOT NULL) AS hits, min(rank) FILTER (e.item IS NOT NULL) AS first_hit FROM expected e FULL OUTER JOIN (SELECT * FROM retrieved WHERE rank <= {k}) t USING (query_id, item) GROUP BY query_id)))"""


def _report(k: int) -> str:
    return f"report{k} AS (UNPIVOT (SELECT round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(f1), 6) AS f1, round(avg(reciprocal_rank), 6) AS reciprocal_rank, round(avg(CASE WHEN recall >= 0.5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS pass_rate FROM at{k}) ON COLUMNS(*) INTO NAME metric VALUE value)"


QUERIES = {
    "sentences": sentences,
    "claims": claims,
    "claim_types": claim_types,
    "claim_scores": claim_scores,
    "citation_coverage": citation_coverage,
    "unused_evidence": unused_evidence,
    "unsupported_claims": unsupported_claims,
    "citations": citations,
    "traceability": traceability,
    "recall_precision": recall_precision,
    "mrr": mrr,
    "ndcg": ndcg,
    "citation_metrics": citation_metrics,
    "eval_report": report,
    "regressions": regressions,
}
SQL = {
    "sentences": f"WITH {_SENTENCES} SELECT * FROM sentences",
    "claims": f"WITH {_CLAIMS} SELECT * FROM claims",
    "claim_types": f"WITH {_CLAIMS} SELECT claim_type, count(*) AS n, count(DISTINCT answer_id) AS n_answers FROM claims GROUP BY claim_type",
    "claim_scores": f"WITH {_LINKS} SELECT answer_id, sentence_index, claim_no, evidence_id, match_score, usage FROM links",
    "citation_coverage": f"""WITH {_LINKS}, c AS (SELECT answer_id, count(*) AS n_claims, count(*) FILTER (EXISTS (SELECT 1 FROM links l WHERE l.answer_id = claims.answer_id AND l.sentence_index = claims.sentence_index AND l.claim_no = claims.claim_no)) AS n_supported FROM claims GROUP BY answer_id)
SELECT *, round(n_supported::DOUBLE / n_claims, 6) AS coverage, CASE WHEN n_claims = n_supported THEN 'VALID' ELSE 'INVALID' END AS status FROM c""",
    "unused_evidence": f"WITH {_LINKS} SELECT answer_id, evidence_id FROM evidence e WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.answer_id = e.answer_id AND l.evidence_id = e.evidence_id)",
    "unsupported_claims": f"WITH {_LINKS} SELECT answer_id, count(*) AS n_unsupported FROM claims c WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.answer_id = c.answer_id AND l.sentence_index = c.sentence_index AND l.claim_no = c.claim_no) GROUP BY answer_id",
    "citations": f"""WITH {_LINKS}, first_use AS (SELECT * FROM links QUALIFY row_number() OVER (PARTITION BY answer_id, evidence_id ORDER BY sentence_index, claim_no) = 1)
SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY sentence_index, claim_no, evidence_id)::INTEGER AS citation_no, evidence_id, CASE evidence_id % 3 WHEN 0 THEN 'Điều ' || evidence_id WHEN 1 THEN 'Khoản 1' ELSE 'Document ' || evidence_id END AS label, usage FROM first_use""",
    "traceability": f"""WITH {_ANSWERS}, anchored AS (SELECT answer_id, evidence_id, evidence_id % 1300 AS document_id, 'v' || (evidence_id % 1300) || '.' || (evidence_id % 3) AS version_id, evidence_id % 8 AS node_id FROM evidence),
cited AS (SELECT * REPLACE (CASE WHEN (evidence_id + answer_id) % 13 = 0 THEN node_id + 1 ELSE node_id END AS node_id) FROM anchored)
SELECT c.*, CASE WHEN (evidence_id + answer_id) % 11 = 0 THEN 'no_matching_evidence' WHEN (evidence_id + answer_id) % 13 = 0 THEN 'disagrees_with_evidence' WHEN NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = c.document_id) THEN 'missing_document' WHEN evidence_id % 3 > 1 THEN 'missing_version' WHEN node_id > 6 THEN 'missing_node' END AS error FROM cited c""",
    "recall_precision": f"WITH {_POOL}, {_at(10)} SELECT * FROM at10",
    "mrr": f"WITH {_POOL}, {_at(10)} SELECT round(avg(reciprocal_rank), 6) AS mrr, count(*) AS n_queries FROM at10",
    "ndcg": f"""WITH {_POOL}, graded AS (SELECT r.query_id, rank, (CASE WHEN e.item IS NOT NULL THEN 2 ELSE 0 END + coalesce(quality, 0))::DOUBLE AS relevance FROM retrieved r LEFT JOIN labels l ON l.doc_id = r.item LEFT JOIN expected e ON e.query_id = r.query_id AND e.item = r.item WHERE rank <= 10),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, rank) AS ideal FROM graded),
sums AS (SELECT query_id, sum((pow(2, relevance) - 1) / log2(rank + 1)) AS dcg, sum((pow(2, relevance) - 1) / log2(ideal + 1)) AS best FROM placed GROUP BY query_id)
SELECT query_id, round(CASE WHEN best = 0 THEN 0 ELSE dcg / best END, 6) AS ndcg FROM sums""",
    "citation_metrics": f"""WITH {_LINKS}, c AS (SELECT answer_id, count(*) AS generated, count(*) % 3 AS expected, least(count(*) FILTER (EXISTS (SELECT 1 FROM links l WHERE l.answer_id = claims.answer_id AND l.sentence_index = claims.sentence_index AND l.claim_no = claims.claim_no)), count(*) % 3) AS correct FROM claims GROUP BY answer_id),
s AS (SELECT *, CASE WHEN generated = 0 THEN 1 ELSE correct::DOUBLE / generated END AS p, CASE WHEN expected = 0 THEN 1 ELSE correct::DOUBLE / expected END AS r FROM c)
SELECT answer_id, generated, expected, correct, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM s""",
    "eval_report": f"WITH {_POOL}, {_at(10)}, {_report(10)} SELECT 'retrieval' AS component, metric, value FROM report10",
    "regressions": f"""WITH {_POOL}, {_at(10)}, {_at(3)}, {_report(10)}, {_report(3)}
SELECT 'retrieval' AS component, c.metric, round(b.value, 4) AS baseline, round(c.value, 4) AS current, round(c.value - b.value, 4) AS difference, CASE WHEN c.value - b.value < -0.05 THEN 'REGRESSION' WHEN c.value - b.value > 0.05 THEN 'IMPROVEMENT' ELSE 'UNCHANGED' END AS status FROM report10 c JOIN report3 b USING (metric)""",
}
