"""Folders of documents as a Spark data source: ``spark.read.format("tesserae_documents").load(folder)``.

One row for each file: path, name, size, kind, mode, lines, needs_ocr, error. Files are dealt to partitions by size, large ones first,
as Spark deals its own: a partition takes files until it holds ``splitBytes``, each counting ``openBytes`` on top of its size. Readers open
one file at a time and yield Arrow batches, so a task holds one file and a bounded batch.

Options: ``glob`` (of the name; default all), ``splitBytes``, ``openBytes``, ``mostBytes`` (a larger file is an error row and isn't
read), and for each kind ``extractor.<kind>`` as ``module:function``, which replaces or adds an extractor of that kind.

Routing: a zip archive is a ``docx``; everything else is tried as digital text first (``pdf``), whatever its first bytes say; text of
fewer than 50 characters goes on to the ``image`` extractor where there is one. A file that fails is a row with its error.
"""

from __future__ import annotations

import fnmatch
import importlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tesserae.sources.files import EXTRACTORS, FEWEST_CHARACTERS, MOST_BYTES, Extractor
from tesserae.sources.store import ASIDE, opened

FORMAT = "tesserae_documents"
SCHEMA = "path string, name string, size long, kind string, mode string, lines array<struct<page_number:int,line_no:int,text:string,confidence:double>>, needs_ocr boolean, error string"
SPLIT, OPEN = 128 << 20, 4 << 20
_LINE = pa.struct([("page_number", pa.int32()), ("line_no", pa.int32()), ("text", pa.string()), ("confidence", pa.float64())])
_ARROW = pa.schema([("path", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("kind", pa.string()), ("mode", pa.string()), ("lines", pa.list_(_LINE)), ("needs_ocr", pa.bool_()), ("error", pa.string())])
#: Text characters and rows of a batch.
_CHARACTERS, _ROWS = 4 << 20, 1000


def hook(name: str):
    """A function by ``module:function``."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def kind_of(content: bytes) -> str:
    return "docx" if content[:4] == b"PK\x03\x04" else "pdf" if content[:4] == b"%PDF" else "unknown"


def route(content: bytes, extractors: dict[str, Extractor]) -> tuple[str, str | None, list, bool, str | None]:
    """kind, mode (docx, digital, image), lines, whether its text is too short to do without OCR, error."""
    kind = kind_of(content)
    first = "docx" if kind == "docx" else "pdf" if "pdf" in extractors else kind
    lines, error, mode = [], None, None
    try:
        if first not in extractors:
            raise LookupError(f"no extractor for {kind}")
        lines, mode = extractors[first](content), "docx" if first == "docx" else "digital"
    except Exception as e:  # a broken file is a row of the result, not the end of the job
        error = f"{type(e).__name__}: {e}"
    short = sum(len(x[2]) for x in lines) < FEWEST_CHARACTERS
    if kind != "docx" and short and "image" in extractors:
        try:
            lines, error, mode = extractors["image"](content), None, "image"
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
    return kind, None if error else mode, [] if error else lines, short, error


@dataclass
class Files(InputPartition):
    """Files that one task reads: (path, size)."""

    files: list[tuple[str, int]]


def dealt(files: list[tuple[str, int]], split: int, open_cost: int) -> list[list[tuple[str, int]]]:
    """Files by size, the largest first, put together until a part holds ``split`` bytes."""
    out: list[list[tuple[str, int]]] = []
    held = split
    for path, size in sorted(files, key=lambda x: (-x[1], x[0])):
        if held + size > split or not out:
            out.append([])
            held = 0
        out[-1].append((path, size))
        held += size + open_cost
    return out


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.glob = options.get("glob", "*")
        number = lambda name, default: int(options.get(name, default))
        self.split, self.open_cost, self.most = number("splitBytes", SPLIT), number("openBytes", OPEN), number("mostBytes", MOST_BYTES)
        self.hooks = {k.split(".", 1)[1]: v for k, v in options.items() if k.lower().startswith("extractor.")}

    def partitions(self) -> list[Files]:
        system, base = opened(self.root)
        info = system.get_file_info(base)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(base, recursive=True))
        hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(base) :].split("/"))
        files = [(x.path, x.size) for x in found if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, self.glob) and not hidden(x.path)]
        return [Files(part) for part in dealt(files, self.split, self.open_cost)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.root)
        extractors = EXTRACTORS | {k: hook(v) for k, v in self.hooks.items()}
        rows, held = [], 0
        for path, size in partition.files:
            if size > self.most:
                found = ("unknown", None, [], False, f"StoreError: {size} bytes are more than {self.most}")
            else:
                with system.open_input_stream(path) as file:
                    found = route(file.readall(), extractors)
            lines = [dict(zip(("page_number", "line_no", "text", "confidence"), x, strict=True)) for x in found[2]]
            rows.append((path, path.rsplit("/", 1)[-1], size, found[0], found[1], lines, found[3], found[4]))
            held += sum(len(x["text"]) for x in lines)
            if held > _CHARACTERS or len(rows) >= _ROWS:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class DocumentSource(DataSource):
    """Registered as ``tesserae_documents``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DocumentReader:
        return DocumentReader(self.options)


def register(spark: SparkSession):
    """A reader of the format; registering again is harmless."""
    spark.dataSource.register(DocumentSource)
    return spark.read.format(FORMAT)


assert ASIDE.startswith("_")  # files that aren't committed are hidden
