"""Queries over files: documents become packages in a store, good and broken, which the data source reads again."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.plans.common import table
from tesserae.sources import documents, store
from tesserae.sources.shared import fresh

#: Documents of one package; what is done to every so many of them.
SHELF, KINDS = 32, 11
_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_STAMP = (2020, 1, 1, 0, 0, 0)


def docx_package(lines: list[str], part: str = "word/document.xml", tail: str = "</w:body></w:document>") -> bytes:
    """A Word package with a paragraph for each line; equal lines give equal bytes."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        package.writestr(zipfile.ZipInfo("[Content_Types].xml", _STAMP), '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>')
        package.writestr(zipfile.ZipInfo(part, _STAMP), f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_NS}"><w:body>{body}{tail}', zipfile.ZIP_DEFLATED)
    return out.getvalue()


def plain_text(content: bytes) -> list[tuple[int, int, str, float]]:
    """An extractor of plain text."""
    return [(1, i + 1, x, 1.0) for i, x in enumerate(s for s in (y.strip() for y in content.decode().split("\n")) if s)]


def _content(shelf: int, lines: list[str]) -> bytes:
    kind = shelf % KINDS
    if kind == 0:
        whole = docx_package(lines)
        return whole[: len(whole) // 2]
    if kind == 1:
        return docx_package(lines, part="word/other.xml")
    if kind == 2:
        return docx_package(lines, tail="")
    if kind == 3:
        return "\n".join(["plain", *lines]).encode()
    return docx_package([] if kind == 4 else lines)


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, name, content: a package for each shelf of documents, that is for each SHELF ids."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    shelves = d.groupBy(F.expr(f"doc_id div {SHELF}").alias("shelf")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("docs"))
    lines = F.flatten(F.transform("docs", lambda x: F.split(x["text"], "\n")))
    clean = lambda x: F.regexp_replace(F.regexp_replace(x, r"[^\x09\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", " "), r"^[\s\u0085\p{Z}]+|[\s\u0085\p{Z}]+$", "")
    cleaned = shelves.select("shelf", F.filter(F.transform(lines, clean), lambda x: x != "").alias("lines"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a package at a time
                shelf, own = batch.column("shelf")[k].as_py(), batch.column("lines")[k].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([str(shelf)]), pa.array([f"shelf-{shelf}.docx"]), pa.array([_content(shelf, own)], pa.binary())], names=["key", "name", "content"])

    return cleaned.mapInArrow(build, "key string, name string, content binary")


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packages, stored and read by the data source; plain text by an extractor of this module."""
    root = fresh(spark, "store")
    store.put(packages(spark, sf_dir), root, fresh(spark, "stored"))
    return documents.register(spark).option("extractor.pdf", f"{__name__}:plain_text").load(root)


def document_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the data source finds in every package: kind, mode, lines, and the kind of error."""
    found = scanned(spark, sf_dir)
    said = F.array_join(F.transform("lines", lambda x: x["text"]), "\n")
    return found.select(
        "name", "kind", "mode", F.size("lines").alias("n_lines"), F.sha2(said, 256).alias("text_sha256"), "needs_ocr", F.split_part("error", F.lit(":"), F.lit(1)).alias("error"),
    )


_SHELVES = f"""lines AS (SELECT doc_id // {SHELF} AS shelf, doc_id, d, unnest(string_split(d, chr(10))) AS line, unnest(range(len(string_split(d, chr(10))))) AS n FROM (SELECT doc_id, coalesce(text, '') AS d FROM documents WHERE doc_id IS NOT NULL)),
clean AS (SELECT shelf, doc_id, d, n, regexp_replace(regexp_replace(line, '[^\\x09\\x20-\\x{{D7FF}}\\x{{E000}}-\\x{{FFFD}}\\x{{10000}}-\\x{{10FFFF}}]', ' ', 'g'), '^[\\s\\x{{85}}\\pZ]+|[\\s\\x{{85}}\\pZ]+$', '', 'g') AS line FROM lines),
shelves AS (SELECT shelf, coalesce(string_agg(line, chr(10) ORDER BY doc_id, d, n) FILTER (line != ''), '') AS body, count(*) FILTER (line != '') AS n_lines, coalesce(sum(length(line)), 0) AS n_chars FROM clean GROUP BY shelf)"""
SCAN_SQL = f"""WITH {_SHELVES},
held AS (SELECT shelf, shelf % {KINDS} AS k, CASE WHEN shelf % {KINDS} < 3 OR shelf % {KINDS} = 4 THEN '' WHEN shelf % {KINDS} = 3 THEN 'plain' || CASE WHEN body = '' THEN '' ELSE chr(10) || body END ELSE body END AS body, CASE WHEN shelf % {KINDS} < 3 OR shelf % {KINDS} = 4 THEN 0 WHEN shelf % {KINDS} = 3 THEN n_lines + 1 ELSE n_lines END AS n_lines, CASE WHEN shelf % {KINDS} < 3 OR shelf % {KINDS} = 4 THEN 0 WHEN shelf % {KINDS} = 3 THEN n_chars + 5 ELSE n_chars END AS n_chars FROM shelves)
SELECT 'shelf-' || shelf || '.docx' AS name, CASE WHEN k = 3 THEN 'unknown' ELSE 'docx' END AS kind, CASE WHEN k < 3 THEN NULL WHEN k = 3 THEN 'digital' ELSE 'docx' END AS mode, n_lines::INTEGER AS n_lines, sha256(body) AS text_sha256, n_chars < {documents.FEWEST_CHARACTERS} AS needs_ocr, CASE k WHEN 0 THEN 'BadZipFile' WHEN 1 THEN 'KeyError' WHEN 2 THEN 'ParseError' END AS error FROM held"""


def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after every fifth package has been deleted: by shard digit, files there, gone, refused references, and bytes read back."""
    root = fresh(spark, "store")
    stored = store.put(packages(spark, sf_dir), root, fresh(spark, "stored"))
    key = F.col("key").cast("long")
    gone = fresh(spark, "deleted")
    store.delete(stored.where(key % 5 == 0).select("storage_ref"), root).write.parquet(gone)
    asked = stored.select("key", "storage_ref", "checksum", "size_bytes").unionByName(stored.where(key % 7 == 0).select("key", F.concat(F.lit("../"), F.col("storage_ref")).alias("storage_ref"), "checksum", "size_bytes"))
    found = store.retrieve(store.exists(asked, root), root)
    deleted = spark.read.parquet(gone)
    rows = found.join(deleted, "storage_ref", "left")
    refused = F.col("storage_ref").startswith("../")
    return rows.groupBy((key % KINDS).alias("kind")).agg(
        F.count_if("stored").alias("n_stored"), F.count_if(F.coalesce("deleted", F.lit(False))).alias("n_deleted"), F.count_if(refused).alias("n_refused"),
        F.count_if(F.sha2("content", 256) == F.col("checksum")).alias("n_whole"), F.count_if(F.octet_length("content") == F.col("size_bytes")).alias("n_sized"),
    )


STORED_SQL = f"""WITH shelves AS (SELECT DISTINCT doc_id // {SHELF} AS shelf FROM documents WHERE doc_id IS NOT NULL)
SELECT shelf % {KINDS} AS kind, count(*) FILTER (shelf % 5 != 0) AS n_stored, count(*) FILTER (shelf % 5 = 0) AS n_deleted, count(*) FILTER (shelf % 7 = 0) AS n_refused, count(*) FILTER (shelf % 5 != 0) AS n_whole, count(*) FILTER (shelf % 5 != 0) AS n_sized FROM shelves GROUP BY ALL"""

QUERIES = {"document_scan": document_scan, "stored_files": stored_files}
SQL = {"document_scan": SCAN_SQL, "stored_files": STORED_SQL}
