"""Stores, the document source, snapshots, merged logs: what the queries don't show."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.operators import merging, registry, reprocessing
from tesserae.plans import files as pf
from tesserae.plans import maintenance
from tesserae.sources import documents, snapshots, store


@pytest.fixture
def contents(spark):
    rows = [("a", "a.txt", b"one"), ("b", "../b/..txt", b"two"), ("c", "c.txt", b"one"), ("d", "d.txt", b""), ("e", None, None), ("f", "a.txt", b"one")]
    return spark.createDataFrame(rows, "key string, name string, content binary").repartition(3)


def files_in(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names if not f.startswith("."))


def test_store_round_trip(spark, contents, tmp_path):
    root = str(tmp_path / "store")
    stored = store.put(contents, root, str(tmp_path / "lists"))
    assert {r.key for r in stored.collect()} == {"a", "b", "c", "f"} and {r.size_bytes for r in stored.collect()} == {3}
    back = {r.key: (bytes(r.content), r.stored) for r in store.exists(store.retrieve(stored, root), root).collect()}
    assert back == {"a": (b"one", True), "b": (b"two", True), "c": (b"one", True), "f": (b"one", True)}
    assert store.listed(spark, root).count() == 3  # a and f are one file
    refs = stored.where("key IN ('a', 'f')").select("storage_ref")
    assert [r.deleted for r in store.delete(refs, root).collect()] == [True] and [r.deleted for r in store.delete(refs, root).collect()] == [False]
    assert {r.key for r in store.exists(stored, root).where("stored").collect()} == {"b", "c"}
    assert store.retrieve(stored.where("key = 'a'"), root).first().content is None


def test_crash_between_phases(spark, contents, tmp_path):
    """What phase 1 has written isn't seen until phase 2, goes in a sweep, and a repeated phase 2 changes nothing."""
    root = str(tmp_path / "store")
    store.write_aside(contents, root).write.parquet(str(tmp_path / "first"))
    written = spark.read.parquet(str(tmp_path / "first"))
    assert store.listed(spark, root).count() == 0 and all(f.startswith(store.ASIDE) for f in files_in(root))
    assert documents.register(spark).load(root).count() == 0
    assert not store.exists(written, root).where("stored").count()
    store.commit(written, root).collect()
    whole = files_in(root)
    store.commit(written, root).collect()  # a task that runs twice
    assert files_in(root) == whole
    store.write_aside(contents, root).collect()  # a run that never commits
    assert store.sweep(root) >= 4 and [f for f in files_in(root) if f.startswith(store.ASIDE)] == []
    assert store.listed(spark, root).count() == 3


@pytest.mark.parametrize("ref", ["../x", "a/../../x", "/etc/passwd", "", "a\\b", "a\0b", "_aside/x", ".."])
def test_traversal(spark, tmp_path, ref):
    with pytest.raises(store.StoreError):
        store.resolve("/root/store", ref)
    rows = spark.createDataFrame([(ref,), (None,)], "storage_ref string")
    (tmp_path / "x").write_text("secret")
    (tmp_path / "store").mkdir()
    root = str(tmp_path / "store")
    assert [r.content for r in store.retrieve(rows, root).collect()] == [None, None] and not store.exists(rows, root).where("stored").count()
    assert all(r.deleted is None for r in store.delete(rows, root).collect()) and (tmp_path / "x").exists()


def test_partitions_by_size():
    files = [(f"f{i}", n) for i, n in enumerate([10, 90, 40, 40, 5, 200])]
    parts = documents.dealt(files, 100, 3)
    assert sorted(x for p in parts for x in p) == sorted(files) and parts[0] == [("f5", 200)]
    assert all(sum(n + 3 for _, n in p) - 3 <= 100 or len(p) == 1 for p in parts)
    assert documents.dealt([], 100, 3) == []


def upper(content):
    return [(1, 1, content.decode().upper(), 0.5)]


def broken(content):
    raise RuntimeError("no engine")


def test_source_options(spark, tmp_path):
    """Extractors by option, the router's order, files that are too large, names by pattern, nested folders."""
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.docx").write_bytes(pf.docx_package(["first line of a package", "second line, so that there is text enough for it"]))
    (tmp_path / "in" / "sub" / "b.bin").write_text("some bytes")
    (tmp_path / "in" / "c.pdf").write_text("%PDF-1.4 scanned")
    (tmp_path / "in" / "_hidden").write_text("x")
    read = lambda **o: {r.name: r for r in documents.register(spark).options(**o).load(str(tmp_path / "in")).collect()}
    here = "tests.test_store"
    found = read(**{"extractor.pdf": f"{here}:upper"})
    assert set(found) == {"a.docx", "b.bin", "c.pdf"}
    assert (found["a.docx"].mode, [x.text for x in found["a.docx"].lines][0], found["a.docx"].needs_ocr) == ("docx", "first line of a package", False)
    assert (found["b.bin"].kind, found["b.bin"].mode, found["b.bin"].lines[0].text, found["b.bin"].needs_ocr) == ("unknown", "digital", "SOME BYTES", True)
    found = read(**{"extractor.pdf": f"{here}:broken", "extractor.image": f"{here}:upper"})
    assert (found["c.pdf"].mode, found["c.pdf"].error, found["c.pdf"].lines[0].confidence) == ("image", None, 0.5)
    found = read(**{"extractor.pdf": f"{here}:broken", "extractor.image": f"{here}:broken", "mostBytes": "12", "glob": "*.[bp]*"})
    assert set(found) == {"b.bin", "c.pdf"} and found["b.bin"].error == "RuntimeError: no engine" and found["c.pdf"].error.startswith("StoreError: 16 bytes")
    assert documents.register(spark).option("splitBytes", 1).load(str(tmp_path / "in")).rdd.getNumPartitions() == 3
    assert documents.register(spark).load(str(tmp_path / "in" / "a.docx")).count() == 1


def test_reader_keeps_its_snapshot(spark, tmp_path):
    root = str(tmp_path / "index")
    rows = spark.range(60).selectExpr("id", "id % 3 AS model", "'v' AS version")
    first = snapshots.publish(rows, root, ["model", "version"])
    reader = snapshots.read(spark, root)
    assert (first.number, reader.count(), snapshots.snapshot(spark, root).parts == first.parts) == (1, 60, True)
    new = rows.where("model = 1 AND id < 10")
    run, parts = snapshots.write_run(new, root, ["model", "version"])  # not published yet
    assert parts == [snapshots.part(["model", "version"], (1, "v"))] and snapshots.read(spark, root).count() == 60
    snapshots.commit(spark, root, first, first.keys, first.schema, first.parts | {parts[0]: [run]})
    assert snapshots.read(spark, root).count() == 40 + 3 and reader.count() == 60 and snapshots.read(spark, root, number=1).count() == 60
    with pytest.raises(snapshots.Conflict):  # a writer that started from the first
        snapshots.publish(new, root, ["model", "version"], base=first)
    assert snapshots.without(spark, root, parts).number == 3 and snapshots.read(spark, root).count() == 40
    assert snapshots.vacuum(spark, root, keep=1) == 3 and snapshots.numbers(spark, root) == [3] and snapshots.read(spark, root).count() == 40


def test_parts_prune_the_scan(spark, tmp_path):
    root = str(tmp_path / "index")
    rows = spark.range(90).selectExpr("id", "concat('m/', id % 3) AS model", "CASE WHEN id % 2 = 0 THEN 'v1' END AS version")
    snapshots.publish(rows, root, ["model", "version"])
    one = snapshots.read(spark, root, parts=[snapshots.part(["model", "version"], ("m/1", None))])
    assert one.count() == 15 and len({f.rsplit("/", 1)[0] for f in one.inputFiles()}) == 1
    plan = snapshots.read(spark, root).where("model = 'm/2'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model" in plan and plan.count("FileScan parquet") == 1
    with pytest.raises(ValueError):
        snapshots.publish(rows.withColumn("x", F.lit(1)), root, ["model", "version"])


def test_only_changed_buckets_are_merged(spark, tmp_path):
    root = str(tmp_path / "log")
    write = lambda rows: spark.createDataFrame(rows, "document_id long, item long, seq long, deleted boolean, amount long")
    merging.appended(write([(i, 0, 1, False, i) for i in range(500)]), root)
    merging.appended(write([(7, 0, 2, False, 700), (8, None, 2, True, None), (9, 0, 2, True, None)]), root)
    want = {(i, i) for i in range(500) if i not in (7, 8, 9)} | {(7, 700)}
    held = lambda: {(r.document_id, r.amount) for r in merging.current(spark, root).collect()}
    assert held() == want
    base = snapshots.snapshot(spark, root)
    changed = merging.compacted(spark, root)
    after = snapshots.snapshot(spark, root)
    assert 1 <= len(changed) <= 3 < len(base.parts) and held() == want
    assert {p for p in base.parts if base.parts[p] != after.parts.get(p)} == set(changed)
    read = snapshots.read(spark, root, parts=changed, of=base).inputFiles()
    assert len(read) == sum(len(base.parts[p]) for p in changed) and merging.compacted(spark, root) == []
    merging.appended(write([(8, 0, 3, False, 88)]), root)  # again after its tombstone
    assert held() == want | {(8, 88)}


def outcome(spark, requests, **document):
    base = {"document_id": 1, "status": "ACTIVE", "state": "READY", "has_result": True, "n_chunks": 3, "n_vectors": 3} | document
    docs = spark.createDataFrame([tuple(base.values())], "document_id long, status string, state string, has_result boolean, n_chunks int, n_vectors int")
    asked = spark.createDataFrame([(i, k, s) for k, (i, s) in enumerate(requests)], "document_id long, seq int, stage string")
    return [(r.error, r.target, r.built, r.stale, r.unindexed, r.state) for r in reprocessing.outcomes(asked, docs).orderBy("seq").collect()]


def test_reprocessing_by_hand(spark):
    """Each rule once, as a coordinator would meet it."""
    whole = "results trees chunks embeddings entries"
    assert outcome(spark, [(1, "OCR ")]) == [(None, "UPLOADED", whole, True, True, "READY")]
    assert outcome(spark, [(1, "parse")], state="FAILED") == [(None, "OCR_COMPLETED", "trees chunks embeddings entries", True, True, "READY")]
    assert outcome(spark, [(1, "embed")]) == [(None, "PARSING_RUNNING", "embeddings entries", True, True, "READY")]
    assert outcome(spark, [(1, "index")]) == [(None, "PARSING_RUNNING", "entries", False, True, "READY")]
    assert outcome(spark, [(1, "tidy")], state="OCR_RUNNING") == [("unsupported stage", None, None, False, False, "OCR_RUNNING")]
    assert outcome(spark, [(2, "ocr")]) == [("document not found", None, None, False, False, None)]
    assert outcome(spark, [(1, "parse")], has_result=False) == [("re-parse needs a result", None, None, False, False, "READY")]
    assert outcome(spark, [(1, "parse")], has_result=False, state="OCR_RUNNING") == [("re-parse needs a result", None, None, False, False, "FAILED")]
    assert outcome(spark, [(1, "embed")], n_chunks=0) == [("re-embed and re-index need chunks", None, None, False, False, "READY")]
    assert outcome(spark, [(1, "ocr")], status="ARCHIVED") == [("archived documents must be restored first", None, None, False, False, "READY")]
    assert outcome(spark, [(1, "ocr")], state=None) == [("no processing state", None, None, False, False, None)]
    # The index is refused only after the document was put back, so it fails even from READY.
    assert outcome(spark, [(1, "index")], n_vectors=2) == [("re-index needs one active vector for every chunk", "PARSING_RUNNING", None, False, False, "FAILED")]
    # What an earlier request has built is there for the next.
    assert [x[0] for x in outcome(spark, [(1, "index"), (1, "embed"), (1, "index")], n_vectors=2)] == ["re-index needs one active vector for every chunk", None, None]
    assert [x[5] for x in outcome(spark, [(1, "parse"), (1, "ocr"), (1, "parse")], has_result=False, state="UPLOADED")] == ["FAILED", "READY", "READY"]


def test_pages_read_their_ranges(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN NULL ELSE id % 7 END AS k")
    order = [F.asc("k"), F.desc("id")]
    registry.write_pages(rows, order, str(tmp_path / "p"), 8)
    whole = [r.id for r in rows.orderBy(*order).collect()]
    for offset in (0, 90, 495, 990, 1000, 5000):
        page = registry.read_page(spark, str(tmp_path / "p"), order, offset, 20)
        assert [r.id for r in page.collect()] == whole[offset : offset + 20]
        assert len(page.inputFiles()) <= 3
        assert all((r.total, r.has_more) == (1000, offset + 20 < 1000) for r in page.collect())
    seek, last, got = [("k", True), ("id", False)], {}, []
    while page := registry.after(rows, seek, last, 150).collect():
        got += [r.id for r in page]
        last = page[-1].asDict()
    assert got == whole
    down = [("k", False), ("id", True)]
    first = registry.after(rows, down, {}, 600).collect()
    assert [r.id for r in first + registry.after(rows, down, first[-1].asDict(), 600).collect()] == [r.id for r in rows.orderBy(F.desc("k"), F.asc("id")).collect()]
    assert "PushedFilters: [IsNotNull(k), GreaterThanOrEqual(k," in registry.after(spark.read.parquet(f"{tmp_path}/p/rows"), seek, {"k": 3, "id": 5}, 5)._jdf.queryExecution().executedPlan().toString()


def test_many_buckets_survive_cascades(spark, sf_dir):
    """Tombstones for a few documents touch few buckets of each table."""
    roots = maintenance._logs(spark, sf_dir)
    gone = spark.createDataFrame([(1,), (2,)], "document_id long")
    before = {t: snapshots.snapshot(spark, r) for t, r in roots.items()}
    merging.cascaded(gone, 9, list(roots.values()), maintenance.BUCKETS)
    for t, r in roots.items():
        after = snapshots.snapshot(spark, r)
        assert sum(after.parts[p] != before[t].parts.get(p) for p in after.parts) <= 2
        assert not merging.current(spark, r).where("document_id IN (1, 2)").count()


assert pa  # batches of the source are Arrow's
