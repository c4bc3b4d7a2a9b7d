"""Registration, vaults' edges and newest collections by hand."""

from pyspark.sql import functions as F

from tesserae.operators import admission, artefacts
from tesserae.plans import files as pf
from tesserae.sources import files


def test_vault_comes_before_the_right(spark):
    vaults = spark.createDataFrame([("a",), ("b",)], "vault_id string")
    may = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "user_id long, vault_id string")
    rows = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 1, "none"), (4, None, "a"), (5, 1, None)], "document_id long, user_id long, vault_id string")
    got = {r.document_id: r.error for r in admission.judged(rows, vaults, may).collect()}
    assert got == {1: None, 2: "not authorized to create documents in the vault", 3: "vault does not exist", 4: "not authorized to create documents in the vault", 5: "vault does not exist"}


def test_registrations_and_edges(spark):
    rows = spark.createDataFrame([(1, "t", "a", "x", [2], [2, 2], [2]), (3, "t", "a", "x", [], [], None), (4, "t", "a", None, [], [None, 1], []), (5, "t", "a", None, [], [], [])], "document_id long, title string, vault_id string, checksum string, supersedes array<long>, amends array<long>, references array<long>")
    assert {r.document_id: (r.state, r.version_number, r.n_same) for r in admission.registered(rows).collect()} == {1: ("UPLOADED", 1, 1), 3: ("UPLOADED", 1, 1), 4: ("UPLOADED", 1, 0), 5: ("UPLOADED", 1, 0)}
    assert {tuple(r) for r in admission.registration_edges(rows).collect()} == {(1, 2, "SUPERSEDES"), (1, 2, "AMENDS"), (1, 2, "REFERENCES"), (4, 1, "AMENDS")}


def test_edges_of_vaults(spark):
    vaults = spark.createDataFrame([("a",), ("b",), ("c",)], "vault_id string")
    events = [(1, "a", 1, "ASSIGN"), (2, "a", 1, "ASSIGN"), (3, "b", 1, "ASSIGN"), (4, "b", 1, "UNASSIGN"), (5, "b", 2, "UNASSIGN"), (6, "b", 2, "ASSIGN"), (7, "a", 3, "ASSIGN"), (8, "a", 3, "UNASSIGN"), (9, "a", 3, "ASSIGN"), (10, "x", 1, "ASSIGN")]
    edges = admission.vault_edges(spark.createDataFrame(events, "seq long, vault_id string, document_id long, action string"), vaults)
    assert {tuple(r) for r in edges.collect()} == {("a", 1, 1), ("b", 2, 6), ("a", 3, 9)}
    assert {tuple(r) for r in admission.vault_counts(edges, vaults).collect()} == {("a", 2), ("b", 1), ("c", 0)}


def test_newest_collection_alone_counts(spark):
    rows = [(1, 1, "old", 1, "c1", 1), (1, 1, "new", 2, "c2", 2), (1, 1, "new", 2, "c3", 2), (1, 2, "x", 1, "c4", 3)]
    found = artefacts.newest_collection(spark.createDataFrame(rows, "document_id int, version_id int, collection_id string, created_at int, chunk_id string, n_declared int"))
    assert {tuple(r) for r in found.collect()} == {(1, 1, 2, 2, 2), (1, 2, 3, 1, 1)}


def test_declared_media_types(spark):
    good = pf.docx_package(["some text"])
    rows = [
        ("a.docx", good, None), ("a.bin", good, files.MIME_DOCX), ("a.docx", good, files.MIME_PDF), ("a.docx", good, "image/png"), ("a.png", good, None), ("a.doc", good, "text/plain"), ("a.docx", good, "application/msword"),
        ("a.bin", good, "text/plain"), ("a.pdf", b"%PDF-1.4", "text/plain"), ("a.png", b"%PDF-1.4", files.MIME_PDF), ("~$a.docx", good, files.MIME_DOCX), ("a.docx", b"", files.MIME_DOCX),
    ]
    out = files.upload_gate(spark.createDataFrame([(n, bytearray(c), m) for n, c, m in rows], "filename string, content binary, mime_type string").coalesce(1)).collect()
    assert [r.reject_reason for r in out] == [None, None, "not a PDF", "future type", "future type", "future type", "future type", "unsupported type", None, None, "lock file", "empty file"]


def test_categories(spark):
    rows = spark.createDataFrame([(None,), ("not_found",), ("timeout",), ("anything",)], "c string")
    assert [r[0] for r in rows.select(admission.category_status("c")).collect()] == [200, 404, 504, 500]
    assert rows.select(admission.category_status(F.lit("conflict"))).first()[0] == 409
