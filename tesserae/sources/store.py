"""A store of files under a root folder: written in two phases, read, tested and deleted by reference.

A reference is ``<first two digits of the checksum>/<checksum>/<file name>``, relative to the root and opaque to callers.

Phase 1: each task writes its contents under ``_aside/<run>/``, under names that no other attempt uses, and reports them.
Phase 2: once the first has succeeded as a whole, tasks rename each file to its place. A rename is atomic, so a place holds a
whole file or none; it happens where the place is still empty, so a repeated task or run changes nothing. What a lost task or a
crash leaves lies in ``_aside`` and is never read; ``sweep`` removes it.

Folders are reached by PyArrow's file systems: local or mounted paths, and the stores that it knows by URI.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASIDE = "_aside"
_STORED = "key string, storage_ref string, checksum string, size_bytes long"


class StoreError(ValueError):
    """A reference or content that the store refuses."""


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder or file; a path without a scheme is local."""
    system, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{posixpath.abspath(uri)}")
    return system, path.rstrip("/") or "/"


def resolve(root: str, ref: str) -> str:
    """The path of a reference under the root; one that leads out of it, or into files not yet committed, is refused."""
    parts = ref.split("/")
    if not ref or "\0" in ref or "\\" in ref or ref.startswith("/") or ".." in parts or parts[0] == ASIDE:
        raise StoreError(f"invalid storage reference: {ref!r}")
    path = posixpath.normpath(posixpath.join(root, ref))
    if not path.startswith(root.rstrip("/") + "/"):
        raise StoreError(f"invalid storage reference: {ref!r}")
    return path


def reference(content: bytes, name: str) -> str:
    if not content:
        raise StoreError("an empty file can't be stored")
    checksum = hashlib.sha256(content).hexdigest()
    return f"{checksum[:2]}/{checksum}/{name.replace('/', '_').replace(chr(92), '_').replace(chr(0), '_') or 'file'}"


def write_aside(files: DataFrame, root: str) -> DataFrame:
    """Phase 1 for files (key, name, content): key, aside, storage_ref, checksum, size_bytes. Empty and null contents are left out."""
    run = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        made = False
        for batch in batches:
            rows = []
            for key, name, content in zip(*(batch.column(c) for c in ("key", "name", "content")), strict=True):
                data = content.as_py()
                if not data:
                    continue
                if not made:
                    system.create_dir(f"{base}/{ASIDE}/{run}", recursive=True)
                    made = True
                aside = f"{ASIDE}/{run}/{uuid.uuid4().hex}"
                with system.open_output_stream(f"{base}/{aside}") as out:
                    out.write(data)
                ref = reference(data, name.as_py() or "")
                rows.append((key.as_py(), aside, ref, ref.split("/")[1], len(data)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["key", "aside", "storage_ref", "checksum", "size_bytes"])

    read = files.select(F.col("key").cast("string").alias("key"), F.col("name").cast("string").alias("name"), F.col("content").cast("binary").alias("content"))
    return read.mapInArrow(write, "key string, aside string, storage_ref string, checksum string, size_bytes long")


def commit(written: DataFrame, root: str) -> DataFrame:
    """Phase 2: renames each file to its place unless that is taken; key, storage_ref, checksum, size_bytes.

    written has to be a table that stands, not a plan that would write anew. A file whose place is taken (by an equal
    content, as the place is its checksum) stays aside until it is swept; one that a first attempt has already renamed is found there.
    """

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        for batch in batches:
            for aside, ref in zip(batch.column("aside").to_pylist(), batch.column("storage_ref").to_pylist(), strict=True):
                place = resolve(base, ref)
                if system.get_file_info(place).type == fs.FileType.NotFound:
                    system.create_dir(posixpath.dirname(place), recursive=True)
                    try:
                        system.move(f"{base}/{aside}", place)
                    except OSError:  # a repeated attempt may have been quicker
                        if system.get_file_info(place).type != fs.FileType.File:
                            raise
            yield batch.select(["key", "storage_ref", "checksum", "size_bytes"])

    return written.mapInArrow(rename, _STORED)


def put(files: DataFrame, root: str, table: str) -> DataFrame:
    """Stores files (key, name, content) and returns key, storage_ref, checksum, size_bytes; table: a new folder for the lists of both phases."""
    spark = files.sparkSession
    write_aside(files, root).write.parquet(f"{table}/written")
    commit(spark.read.parquet(f"{table}/written"), root).write.parquet(f"{table}/stored")
    return spark.read.parquet(f"{table}/stored")


def _each(refs: DataFrame, column: str, root: str, kind: str, do) -> DataFrame:
    """refs with one column more: do(file system, path or None for a refused reference)."""
    at, names, arrow = column, refs.columns, {"boolean": pa.bool_(), "binary": pa.binary()}[kind.split()[1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        for batch in batches:
            out = []
            for ref in batch.column(at).to_pylist():
                try:
                    path = resolve(base, ref or "")
                except StoreError:
                    path = None
                out.append(None if path is None else do(system, path))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], names=[*names, kind.split()[0]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in refs.schema.fields)
    return refs.mapInArrow(run, f"{fields}, {kind}")


def _is_file(system: fs.FileSystem, path: str) -> bool:
    return system.get_file_info(path).type == fs.FileType.File


def retrieve(refs: DataFrame, root: str, column: str = "storage_ref") -> DataFrame:
    """refs with content: null for what isn't there or isn't a valid reference."""
    return _each(refs, column, root, "content binary", lambda system, path: system.open_input_stream(path).readall() if _is_file(system, path) else None)


def exists(refs: DataFrame, root: str, column: str = "storage_ref") -> DataFrame:
    """refs with ``stored``: whether the file is there; false for an invalid reference."""
    return _each(refs, column, root, "stored boolean", _is_file).withColumn("stored", F.coalesce("stored", F.lit(False)))


def delete(refs: DataFrame, root: str, column: str = "storage_ref") -> DataFrame:
    """Deletes files by reference, each once, and returns the references with ``deleted``: false for what wasn't there, null for an invalid one.

    The work is done when the result is written or collected; done again it reports false.
    """

    def gone(system: fs.FileSystem, path: str) -> bool:
        if not _is_file(system, path):
            return False
        system.delete_file(path)
        return True

    return _each(refs.select(column).distinct(), column, root, "deleted boolean", gone)


def sweep(root: str, keep_seconds: float = 0.0) -> int:
    """Removes what runs left aside at least so long ago; how many files that were. Not to be called with 0 while others write."""
    import time

    system, base = opened(root)
    n = 0
    for x in system.get_file_info(fs.FileSelector(f"{base}/{ASIDE}", recursive=True, allow_not_found=True)):
        if x.type == fs.FileType.File and (not keep_seconds or x.mtime_ns is None or time.time() - x.mtime_ns / 1e9 >= keep_seconds):
            system.delete_file(x.path)
            n += 1
    return n


def listed(spark: SparkSession, root: str) -> DataFrame:
    """storage_ref, size_bytes of all committed files, as the store's folders have them."""
    system, base = opened(root)
    shards = [x.base_name for x in system.get_file_info(fs.FileSelector(base, allow_not_found=True)) if x.type == fs.FileType.Directory and x.base_name != ASIDE]

    def ls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        for batch in batches:
            for shard in batch.column("shard").to_pylist():
                found = [(x.path[len(base) + 1 :], x.size) for x in system.get_file_info(fs.FileSelector(f"{base}/{shard}", recursive=True)) if x.type == fs.FileType.File]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["storage_ref", "size_bytes"])

    # At most 256 folders: the listing itself is done by tasks.
    return spark.createDataFrame([(s,) for s in shards], "shard string").mapInArrow(ls, "storage_ref string, size_bytes long")
