"""Files to lines and tables: scans, the upload gate, routing, markup, JSON lines, content-addressed storage."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import collapse, sanitised_filename

LINE = "page_number int, line_no int, text string, confidence double"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MOST_BYTES, FEWEST_CHARACTERS = 100 << 20, 50

Extractor = Callable[[bytes], list[tuple[int, int, str, float]]]


def docx_lines(content: bytes) -> list[tuple[int, int, str, float]]:
    """A line for each paragraph with text, all on one page."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    found = ("".join(t.text or "" for t in p.iter(f"{_W}t")).strip() for p in root.iter(f"{_W}p"))
    return [(1, i + 1, line, 1.0) for i, line in enumerate(x for x in found if x)]


def pdf_lines(content: bytes) -> list[tuple[int, int, str, float]]:
    """Lines of a digital PDF; needs the optional PyMuPDF."""
    import fitz

    out: list[tuple[int, int, str, float]] = []
    with fitz.open(stream=content, filetype="pdf") as book:
        for number, page in enumerate(book, 1):
            blocks = (b for b in page.get_text("dict")["blocks"] if b["type"] == 0)
            found = ("".join(s["text"] for s in line["spans"]).strip() for b in blocks for line in b["lines"])
            out += [(number, i + 1, x, 1.0) for i, x in enumerate(y for y in found if y)]
    return out


#: Extractors by kind; image text (OCR) is a hook that a deployment registers under "image".
EXTRACTORS: dict[str, Extractor] = {"docx": docx_lines, "pdf": pdf_lines}


def kind_of(content: Column) -> Column:
    """docx for zip archives, pdf for PDFs, else unknown."""
    return F.when(F.hex(F.substring(content, 1, 4)) == "504B0304", "docx").when(F.hex(F.substring(content, 1, 4)) == "25504446", "pdf").otherwise("unknown")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """document_id (path), content, kind."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("document_id"), "content", kind_of(F.col("content")).alias("kind"))


def extract_lines(files: DataFrame, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """document_id, lines, needs_ocr, error: files to lines, kind by kind; a file that fails has none and says why.

    Files whose text is shorter than FEWEST_CHARACTERS go to the "image" extractor where there is one.
    """
    known = EXTRACTORS if extractors is None else extractors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, content, kind in zip(batch["document_id"], batch["content"], batch["kind"], strict=True):
                found, error = [], None
                try:
                    found = known[kind](bytes(content)) if kind in known else []
                    error = None if kind in known else f"no extractor for {kind}"
                except Exception as e:  # a broken file is a row of the result, not the end of the job
                    error = f"{type(e).__name__}: {e}"
                short = sum(len(x[2]) for x in found) < FEWEST_CHARACTERS
                if short and "image" in known:
                    found, error = known["image"](bytes(content)), None
                out.append((doc, [dict(zip(("page_number", "line_no", "text", "confidence"), x, strict=True)) for x in found], short, error))
            yield pd.DataFrame(out, columns=["document_id", "lines", "needs_ocr", "error"])

    return files.select("document_id", "content", "kind").mapInPandas(run, f"document_id string, lines array<struct<{LINE.replace(' int', ':int').replace(' string', ':string').replace(' double', ':double')}>>, needs_ocr boolean, error string")


def flat_lines(extracted: DataFrame) -> DataFrame:
    return extracted.select("document_id", F.explode("lines").alias("l")).select("document_id", "l.*")


def page_confidence(lines: DataFrame) -> DataFrame:
    """Of each document: mean and least page confidence, mean line confidence; a page's is the mean of its lines'."""
    pages = lines.groupBy("document_id", "page_number").agg(F.avg("confidence").alias("page"), F.sum("confidence").alias("total"), F.count("*").alias("n"))
    return pages.groupBy("document_id").agg(F.round(F.avg("page"), 4).alias("page_confidence"), F.round(F.min("page"), 4).alias("least_page"), F.round(F.sum("total") / F.sum("n"), 4).alias("line_confidence"))


def has_text(lines: DataFrame, least: int = 10) -> DataFrame:
    """Documents with more than least characters of text."""
    return lines.groupBy("document_id").agg(F.sum(F.length("text")).alias("n_chars")).where(F.col("n_chars") > least)


def docx_problem(content: bytes, most: int = 10 * MOST_BYTES) -> str | None:
    """Why a file isn't a Word document with text, or None. Parts are read only if all of them expand to at most most bytes."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as package:
            sizes = {i.filename: i.file_size for i in package.infolist()}
            if sum(sizes.values()) > most:
                return "DOCX expands too far"
            if "word/document.xml" not in sizes:
                return "DOCX without main part"
            if package.testzip() is not None:
                return "DOCX with a corrupt part"
            root = ElementTree.fromstring(package.read("word/document.xml"))
    except zipfile.BadZipFile:
        return "broken DOCX package"
    except ElementTree.ParseError:
        return "DOCX with invalid XML"
    if root.tag != f"{_W}document":
        return "DOCX main part is another document"
    return None if any((t.text or "").strip() for t in root.iter(f"{_W}t")) else "DOCX without text"


#: Media types that are taken, and those that are named but not taken yet, with their extensions.
MIME_PDF = "application/pdf"
MIME_DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
FUTURE_TYPES = {"application/msword": ("doc",), "image/tiff": ("tiff", "tif"), "image/png": ("png",), "image/jpeg": ("jpg", "jpeg")}


def upload_gate(files: DataFrame) -> DataFrame:
    """Adds accepted, reject_reason, checksum, stored_name, shard to files (filename, content, and mime_type where it is declared).

    A declared media type that is taken says what the file is; one that is to come is refused; else the name's extension says it.
    """
    extension = F.lower(F.regexp_extract("filename", r"\.([A-Za-z0-9]+)$", 1))
    future = F.lit(False)
    if "mime_type" in files.columns:
        declared = F.col("mime_type")
        told = F.when(declared == MIME_PDF, "pdf").when(declared == MIME_DOCX, "docx")
        future = F.coalesce(declared.isin(*FUTURE_TYPES), F.lit(False)) | (told.isNull() & extension.isin(*[e for es in FUTURE_TYPES.values() for e in es]))
        extension = F.coalesce(told, extension)
    kind, size = kind_of(F.col("content")), F.octet_length("content")
    reason = (
        F.when(future, "future type")
        .when(F.col("filename").startswith("~$"), "lock file")
        .when(~extension.isin("pdf", "docx"), "unsupported type")
        .when(F.coalesce(size, F.lit(0)) == 0, "empty file")
        .when(size > MOST_BYTES, "too large")
        .when((extension == "pdf") & (kind != "pdf"), "not a PDF")
        .when((extension == "docx") & (kind != "docx"), "not a DOCX")
    )

    @F.pandas_udf("string")
    def problems(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: None if c is None else docx_problem(bytes(c)))

    # Packages are opened only where all the rest holds; others go to the check as null.
    reason = F.coalesce(reason, problems(F.when(reason.isNull() & (kind == "docx"), F.col("content"))))
    checksum = F.sha2("content", 256)
    return files.withColumns({"accepted": reason.isNull(), "reject_reason": reason, "checksum": checksum, "stored_name": sanitised_filename("filename"), "shard": F.substring(checksum, 1, 2)})


def store(files: DataFrame, path: str) -> None:
    """Accepted contents, each once, by checksum under the first two of its digits."""
    kept = files.where("accepted").select("checksum", "shard", "content").dropDuplicates(["checksum"])
    kept.write.mode("append").partitionBy("shard").parquet(path)


def new_documents(files: DataFrame, known: DataFrame) -> DataFrame:
    """Accepted files whose content isn't registered yet, each content once, as documents. known: checksum."""
    fresh = files.where("accepted").join(known.select("checksum").distinct(), "checksum", "left_anti")
    once = fresh.groupBy("checksum").agg(F.min("stored_name").alias("title"))
    return once.select(F.substring("checksum", 1, 32).alias("document_id"), "checksum", "title", F.lit("UPLOADED").alias("state"), F.lit(1).alias("version_number"))


def write_report(rows: DataFrame, path: str) -> None:
    """A report (component, metric, value) as JSON lines."""
    rows.select("component", "metric", "value").write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("component string, metric string, value double").json(path)


AUDIT = "service string, event string, entity_type string, entity_id string, severity string, message string, at timestamp"


def append_audit(events: DataFrame, path: str) -> None:
    """Adds audit events to their table, by day; rows are never changed."""
    events.select(*[c.split()[0] for c in AUDIT.split(", ")], F.to_date("at").alias("day")).write.mode("append").partitionBy("day").parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{AUDIT}, day date").parquet(path)


def html_text(html: Column) -> Column:
    """Text of a page: without scripts, styles, comments and tags; common entities resolved; single spaces."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->|<[^>]+>", " ")
    for entity, character in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(character))
    return collapse(bare)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions, one JSON object a line."""
    return spark.read.schema("id string, category string, query string, expected_doc string, expected_ref string, should_abstain boolean, ground_truth string").json(path)


def log_lines(entries: DataFrame, level: str = "INFO") -> DataFrame:
    """value: one JSON object for each entry of the level and above."""
    levels = F.array(*map(F.lit, ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")))
    kept = entries.where(F.array_position(levels, F.col("level")) >= F.array_position(levels, F.lit(level)))
    return kept.select(F.to_json(F.struct(*entries.columns)).alias("value"))
