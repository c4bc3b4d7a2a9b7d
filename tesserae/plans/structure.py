"""Structure and chunking queries over documents whose lines carry a fixed overlay of headings.

The driver's texts hold no headings; line i of a document (from 0, blank lines left out) is prefixed by a rule of i,
so that every heading type occurs, in both languages alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions.text import token_estimate
from tesserae.operators import chunking, structure
from tesserae.plans.common import DOCUMENTS, documents, strip_sql

#: Chunk sizes of the queries: small, so that every rule fires on short documents.
CONFIG = chunking.Chunking(most=96, merge_below=40)


def plain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.lines(documents(spark, sf_dir))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plain_lines(spark, sf_dir)
    i = F.row_number().over(Window.partitionBy("document_id").orderBy("line_no")) - 1
    rows = rows.withColumn("i", i)
    n = F.floor(F.col("i") / 7).cast("string")
    head = (
        F.when(F.col("i") % 91 == 90, F.concat(F.lit("Phụ lục A"), n, F.lit(" ")))
        .when(F.col("i") % 35 == 3, F.lit("Chương II "))
        .when(F.col("i") % 35 == 4, F.lit("Mục 1. "))
        .when(F.col("i") % 7 == 5, F.concat(F.lit("Điều "), n, F.lit(". ")))
        .when(F.col("i") % 7 == 6, F.lit("1. "))
        .when(F.col("i") % 7 == 0, F.lit("2. "))
        .when(F.col("i") % 7 == 1, F.lit("a) "))
        .otherwise(F.lit("- "))
    )
    return rows.select("document_id", "page_number", "line_no", F.concat(head, F.col("text")).alias("text"))


_PLAIN = f"""{DOCUMENTS},
cut AS (SELECT document_id, string_split(coalesce(text, ''), chr(10)) AS l FROM docs),
raw AS (SELECT document_id, unnest(l) AS t, unnest(range(0, len(l))) AS pos FROM cut),
plain AS (SELECT document_id, (pos // 20 + 1)::INTEGER AS page_number, (pos + 1)::INTEGER AS line_no, {strip_sql('t')} AS text FROM raw WHERE {strip_sql('t')} != '')"""
_LINES = f"""{_PLAIN},
numbered AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY line_no) - 1 AS i FROM plain),
lined AS (SELECT document_id, page_number, line_no, CASE WHEN i % 91 = 90 THEN 'Phụ lục A' || (i // 7) || ' ' WHEN i % 35 = 3 THEN 'Chương II ' WHEN i % 35 = 4 THEN 'Mục 1. ' WHEN i % 7 = 5 THEN 'Điều ' || (i // 7) || '. ' WHEN i % 7 = 6 THEN '1. ' WHEN i % 7 = 0 THEN '2. ' WHEN i % 7 = 1 THEN 'a) ' ELSE '- ' END || text AS text FROM numbered)"""


def _case(pick) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(text, '{p.replace('(?iu)', '(?i)')}') THEN {pick(name, p.replace('(?iu)', '(?i)'), label)}" for name, p, label in structure.HEADINGS) + " END"


def _title(name: str, p: str, label: str) -> str:
    own, rest = f"'{label} ' || regexp_extract(text, '{p}', 1)", strip_sql(f"regexp_extract(text, '{p}', 2)")
    return own if name in ("CLAUSE", "POINT") else f"CASE WHEN {rest} = '' THEN {own} ELSE {rest} END"


_CLASSIFIED = f"""{_LINES},
classified AS (SELECT *, {_case(lambda n, p, x: f"'{n}'")} AS type, {_case(lambda n, p, x: f"regexp_extract(text, '{p}', 1)")} AS number, {_case(_title)} AS title, {_case(lambda n, p, x: strip_sql(f"regexp_extract(text, '{p}', 2)") if n in ('CLAUSE', 'POINT') else 'text')} AS body FROM lined)"""
_SECTIONS = f"""{_CLASSIFIED},
marked AS (SELECT *, coalesce(bool_or(type IS NOT DISTINCT FROM 'ARTICLE') OVER b, false) AS seen, max(CASE WHEN type IS NOT NULL THEN line_no END) OVER b AS last_heading, min(CASE WHEN type IN ('CHAPTER', 'ARTICLE', 'APPENDIX') THEN line_no END) OVER n AS next_flush, min(CASE WHEN type IN ('CHAPTER', 'ARTICLE', 'APPENDIX') THEN page_number END) OVER n AS flush_page, max(line_no) OVER d AS end_line, max(page_number) OVER d AS end_page FROM classified WINDOW b AS (PARTITION BY document_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n AS (PARTITION BY document_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), d AS (PARTITION BY document_id)),
placed AS (SELECT *, CASE WHEN type IS NULL AND NOT seen THEN coalesce(next_flush, 2147483647) WHEN type IS NULL THEN last_heading ELSE line_no END AS spot, CASE WHEN type IS NULL AND NOT seen THEN 0 ELSE 1 END AS part FROM marked),
grouped AS (SELECT document_id, spot, part, max(type) AS type, max(number) AS number, max(title) AS title, string_agg(coalesce(body, text), chr(10) ORDER BY line_no) AS text, min(page_number) AS page_start, min(line_no) AS line_start, CASE WHEN part = 0 THEN coalesce(max(flush_page), max(end_page)) ELSE min(page_number) END AS page_end, CASE WHEN part = 0 THEN coalesce(max(next_flush) - 1, max(end_line)) ELSE min(line_no) END AS line_end FROM placed GROUP BY document_id, spot, part),
sections AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY spot, part) AS ord, coalesce(type, 'PREAMBLE') AS type, number, coalesce(title, 'Preamble') AS title, {strip_sql('text')} AS text, page_start, page_end, line_start, line_end FROM grouped)"""
# The oracle states the parents by correlated subqueries over earlier sections of the group, not by running windows.
_NODES = f"""{_SECTIONS},
units AS (SELECT *, max(CASE WHEN type IN ('PREAMBLE', 'CHAPTER', 'ARTICLE', 'APPENDIX') THEN ord END) OVER (PARTITION BY document_id ORDER BY ord) AS u FROM sections),
inner_ones AS (SELECT document_id, u, min(ord) AS first_inner, min_by(type, ord) AS first_type FROM units WHERE type IN ('CLAUSE', 'POINT') GROUP BY ALL),
part_ones AS (SELECT document_id, u, min(ord) AS first_section FROM units WHERE type = 'SECTION' GROUP BY ALL),
clauses AS (SELECT document_id, u, ord AS clause FROM units WHERE type = 'CLAUSE'),
parts AS (SELECT document_id, u, ord AS section FROM units WHERE type = 'SECTION'),
points AS (SELECT p.document_id, p.ord, max(c.clause) AS clause FROM units p JOIN clauses c ON c.document_id = p.document_id AND c.u IS NOT DISTINCT FROM p.u AND c.clause < p.ord WHERE p.type = 'POINT' AND NOT EXISTS (SELECT 1 FROM parts s WHERE s.document_id = p.document_id AND s.u IS NOT DISTINCT FROM p.u AND s.section > c.clause AND s.section < p.ord) GROUP BY ALL),
parented AS (SELECT x.document_id, x.ord, x.type, x.number, x.title, x.text, x.page_start, x.page_end, x.line_start, CASE
 WHEN x.type = 'SECTION' AND h.type = 'CHAPTER' AND NOT coalesce(i.first_inner < x.ord, false) THEN x.u
 WHEN x.type = 'CLAUSE' AND h.type = 'ARTICLE' AND NOT coalesce(s.first_section < x.ord, false) AND i.first_type = 'CLAUSE' THEN x.u
 WHEN x.type = 'POINT' THEN coalesce(q.clause, 0) ELSE 0 END AS parent
 FROM units x LEFT JOIN sections h ON h.document_id = x.document_id AND h.ord = x.u LEFT JOIN inner_ones i ON i.document_id = x.document_id AND i.u IS NOT DISTINCT FROM x.u LEFT JOIN part_ones s ON s.document_id = x.document_id AND s.u IS NOT DISTINCT FROM x.u LEFT JOIN points q ON q.document_id = x.document_id AND q.ord = x.ord),
tree AS (WITH RECURSIVE t AS (SELECT document_id, ord, 1 AS depth FROM parented WHERE parent = 0 UNION ALL SELECT p.document_id, p.ord, t.depth + 1 FROM parented p JOIN t ON t.document_id = p.document_id AND t.ord = p.parent) SELECT * FROM t),
nodes AS (SELECT p.*, row_number() OVER (PARTITION BY document_id, parent ORDER BY ord) - 1 AS sibling, depth FROM parented p JOIN tree USING (document_id, ord))"""


def _number_sql() -> str:
    tries = [f"nullif(regexp_extract(coalesce({f}, ''), '{p.replace('(?iu)', '(?i)')}', 1), '')" for f in ("title", "text") for p in (structure.NUMBER_FIRST, structure.NUMBER_NAMED)]
    return f"coalesce({', '.join(tries)})"


_LABEL = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in structure.LABELS.items()) + " END"
_WALKED = f"""{_NODES},
own AS (SELECT *, {_LABEL} || coalesce(' ' || {_number_sql()}, '') AS own_reference, coalesce({_number_sql()}, (sibling + 1)::VARCHAR) AS step FROM nodes),
walked AS (WITH RECURSIVE w AS (SELECT document_id, ord, own_reference AS reference, '1.' || step AS path FROM own WHERE parent = 0 UNION ALL SELECT o.document_id, o.ord, w.reference || ' ' || o.own_reference, w.path || '.' || o.step FROM own o JOIN w ON w.document_id = o.document_id AND w.ord = o.parent) SELECT o.document_id, o.ord, o.type, o.title, o.text, o.parent, o.sibling, o.depth, o.page_start, o.own_reference, w.reference, w.path FROM own o JOIN w USING (document_id, ord))"""


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.sections(structure.classify(lines(spark, sf_dir)))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.hierarchy(sections(spark, sf_dir))


def walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers are taken before the windows of the hierarchy, so that these carry texts only for who asks for texts."""
    numbered = sections(spark, sf_dir).withColumn("own_number", structure.number_of("title", "text"))
    return structure.references(structure.hierarchy(numbered)).drop("own_number")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_lines(spark, sf_dir).select("document_id", "page_number", "line_no", "text")


def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_lines(spark, sf_dir).groupBy("document_id", "page_number").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count("*").alias("n_lines"))


def line_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.classify(lines(spark, sf_dir)).select("document_id", "line_no", "type", "number", "title", "body")


def preamble_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(spark, sf_dir).select("document_id", "ord", "type", "title", F.md5("text").alias("text_md5"), "page_start", "page_end", "line_start", "line_end")


def hierarchy_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select("document_id", "ord", "type", "parent", F.col("sibling").cast("long").alias("sibling"), "depth")


def canonical_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walked(spark, sf_dir).select("document_id", "ord", "reference", "short_reference")


def node_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walked(spark, sf_dir).select("document_id", "ord", "path")


def tree_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.statistics(nodes(spark, sf_dir))


def tree_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.violations(walked(spark, sf_dir)).groupBy("document_id", "problem", "severity").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


def tree_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of each node, in order."""
    return nodes(spark, sf_dir).groupBy("document_id", "parent").agg(F.count("*").alias("n_children"), F.array_join(F.transform(F.array_sort(F.collect_list("ord")), lambda o: o.cast("string")), ",").alias("children"))


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("document_id", token_estimate("text").alias("tokens"))


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.subtree_sizes(chunking.with_root(walked(spark, sf_dir)))


def chunk_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.cut(sized(spark, sf_dir), CONFIG).select("document_id", "ord", "type", "tokens", "n_chars", "oversized")


_SIZED = f"""{_WALKED},
every AS (SELECT document_id, ord, type, title, text, parent, depth, path, reference FROM walked UNION ALL SELECT DISTINCT document_id, 0, 'DOCUMENT', 'Document', '', -1, 0, '1', '' FROM walked),
above AS (WITH RECURSIVE a AS (SELECT document_id, ord, ord AS top FROM every UNION ALL SELECT e.document_id, e.ord, a.top FROM every e JOIN a ON a.document_id = e.document_id AND a.ord = e.parent) SELECT * FROM a),
owned AS (SELECT document_id, ord, concat_ws(chr(10), nullif(title, ''), CASE WHEN text != '' AND text IS DISTINCT FROM title THEN text END) AS own FROM every),
sub AS (SELECT a.document_id, a.top AS ord, coalesce(string_agg(o.own, chr(10) ORDER BY o.ord) FILTER (o.own != ''), '') AS whole, count(*) AS n FROM above a JOIN owned o USING (document_id, ord) GROUP BY ALL),
sized AS (SELECT e.*, s.whole, s.n, CASE WHEN length(whole) = 0 THEN 0 ELSE greatest(1, length(whole) // 4) END AS tokens, length(whole)::BIGINT AS n_chars FROM every e JOIN sub s USING (document_id, ord)),
chosen AS (SELECT c.*, c.tokens > {CONFIG.most} AS oversized FROM sized c LEFT JOIN sized p ON p.document_id = c.document_id AND p.ord = c.parent WHERE (p.ord IS NULL OR p.tokens > {CONFIG.most}) AND (c.tokens <= {CONFIG.most} OR c.n = 1))"""


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.cut_texts(sized(spark, sf_dir), CONFIG).select("document_id", "ord", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


def chunk_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of whole texts that are longer than a chunk. Greedy cuts have no closed form: tested against a plain loop."""
    parts = chunking.split_oversized(documents(spark, sf_dir).select("document_id", "text"))
    return parts.select("document_id", "part", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def mergeable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.cut_texts(sized(spark, sf_dir), CONFIG).select("document_id", "ord", chunking.chunk_type_of(F.col("type")).alias("chunk_type"), "tokens", "path", "text", "reference")


def chunk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunking.merge_small(mergeable(spark, sf_dir), CONFIG)
    return out.select("document_id", "ord", "chunk_type", "tokens", "path", F.md5("text").alias("text_md5"), F.array_join("references", "; ").alias("refs"), F.size("node_ords").cast("long").alias("n_nodes"))


_TYPES = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in chunking.CHUNK_TYPES.items()) + " END"
# The oracle makes the greedy pass itself, chunk after chunk.
CHUNK_MERGE_SQL = f"""WITH RECURSIVE {_SIZED},
small AS (SELECT document_id, ord, {_TYPES} AS chunk_type, tokens, path, whole AS text, reference, regexp_replace(path, '\\.?[^.]*$', '') AS prefix, row_number() OVER (PARTITION BY document_id ORDER BY ord) AS k FROM chosen),
able AS (SELECT a.*, b.ord IS NOT NULL AS able, b.tokens AS t2, b.text AS x2, b.reference AS r2 FROM small a LEFT JOIN small b ON b.document_id = a.document_id AND b.k = a.k + 1 AND a.chunk_type NOT IN ('ARTICLE', 'CLAUSE', 'POINT', 'CHAPTER', 'SECTION', 'APPENDIX') AND a.tokens < {CONFIG.merge_below} AND a.prefix = b.prefix AND a.tokens + b.tokens <= {CONFIG.most}),
pass AS (SELECT document_id, 1::BIGINT AS k FROM able WHERE k = 1 UNION ALL SELECT a.document_id, p.k + CASE WHEN q.able THEN 2 ELSE 1 END FROM pass p JOIN able q ON q.document_id = p.document_id AND q.k = p.k JOIN able a ON a.document_id = p.document_id AND a.k = p.k + CASE WHEN q.able THEN 2 ELSE 1 END)
SELECT a.document_id, a.ord, CASE WHEN able THEN 'COMPOSITE' ELSE chunk_type END AS chunk_type, CASE WHEN able THEN a.tokens + t2 ELSE a.tokens END AS tokens, path, md5(CASE WHEN able THEN concat_ws(chr(10), nullif(a.text, ''), nullif(x2, '')) ELSE a.text END) AS text_md5, concat_ws('; ', nullif(a.reference, ''), CASE WHEN able THEN nullif(r2, '') END) AS refs, CASE WHEN able THEN 2 ELSE 1 END::BIGINT AS n_nodes FROM pass JOIN able a USING (document_id, k)"""

QUERIES = {
    "doc_lines": doc_lines,
    "line_numbers": line_numbers,
    "line_classify": line_classify,
    "preamble_islands": preamble_islands,
    "hierarchy_nodes": hierarchy_nodes,
    "canonical_reference": canonical_reference,
    "node_path": node_path,
    "tree_statistics": tree_statistics,
    "tree_violations": tree_violations,
    "tree_children": tree_children,
    "token_estimate": token_estimates,
    "chunk_fit": chunk_fit,
    "chunk_texts": chunk_texts,
    "chunk_split": chunk_split,
    "chunk_merge": chunk_merge,
}
SQL = {
    "doc_lines": f"WITH {_PLAIN} SELECT * FROM plain",
    "line_numbers": f"WITH {_PLAIN} SELECT document_id, page_number, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n_lines FROM plain GROUP BY ALL",
    "line_classify": f"WITH {_CLASSIFIED} SELECT document_id, line_no, type, number, title, body FROM classified",
    "preamble_islands": f"WITH {_SECTIONS} SELECT document_id, ord, type, title, md5(text) AS text_md5, page_start, page_end, line_start, line_end FROM sections",
    "hierarchy_nodes": f"WITH {_NODES} SELECT document_id, ord, type, parent, sibling, depth FROM nodes",
    "canonical_reference": f"WITH {_WALKED} SELECT document_id, ord, reference, own_reference AS short_reference FROM walked",
    "node_path": f"WITH {_WALKED} SELECT document_id, ord, path FROM walked",
    "tree_statistics": f"WITH {_NODES} SELECT document_id, count(*) + 1 AS n_nodes, max(depth) AS max_depth, count(*) FILTER (type = 'ARTICLE') AS n_article, count(*) FILTER (type = 'CLAUSE') AS n_clause, count(*) FILTER (type = 'APPENDIX') AS n_appendix, greatest(1, max(page_end)) AS last_page FROM nodes GROUP BY document_id",
    "tree_violations": f"""WITH {_WALKED}, found AS (
SELECT document_id, ord, 'duplicate_reference' AS problem, 'warning' AS severity FROM walked w WHERE reference != '' AND EXISTS (SELECT 1 FROM walked v WHERE v.document_id = w.document_id AND v.reference = w.reference AND v.ord < w.ord)
UNION ALL SELECT document_id, ord, 'duplicate_path', 'warning' FROM walked w WHERE EXISTS (SELECT 1 FROM walked v WHERE v.document_id = w.document_id AND v.path = w.path AND v.ord < w.ord)
UNION ALL SELECT document_id, ord, 'orphan', 'error' FROM walked w WHERE parent != 0 AND NOT EXISTS (SELECT 1 FROM walked v WHERE v.document_id = w.document_id AND v.ord = w.parent)
UNION ALL SELECT document_id, ord, 'cycle', 'error' FROM walked w WHERE parent >= ord)
SELECT document_id, problem, severity, count(*) AS n, min(ord) AS first_ord FROM found GROUP BY ALL""",
    "tree_children": f"WITH {_NODES} SELECT document_id, parent, count(*) AS n_children, string_agg(ord, ',' ORDER BY ord) AS children FROM nodes GROUP BY ALL",
    "token_estimate": "SELECT doc_id AS document_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END::BIGINT AS tokens FROM documents",
    "chunk_fit": f"WITH {_SIZED} SELECT document_id, ord, type, tokens, n_chars, oversized FROM chosen",
    "chunk_texts": f"WITH {_SIZED} SELECT document_id, ord, md5(whole) AS text_md5, n_chars FROM chosen",
    "chunk_merge": CHUNK_MERGE_SQL,
}
