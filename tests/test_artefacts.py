"""Artefact tables, upload checks, reports, audit, reprocessing and the provider hook by cases made by hand."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tesserae.functions import text as tx
from tesserae.operators import admin, artefacts, evaluation
from tesserae.sources import files

MAIN = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:body></w:document>'


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", text)
    return out.getvalue()


@pytest.mark.parametrize(
    ("content", "problem"),
    [
        (package(word__document=MAIN.format("Điều 1")), None),
        (package(word__document=MAIN.format(" ")), "DOCX without text"),
        (package(word__other="x"), "DOCX without main part"),
        (package(word__document="<a"), "DOCX with invalid XML"),
        (package(word__document="<a>b</a>"), "DOCX main part is another document"),
        (b"PK\x03\x04 no package", "broken DOCX package"),
        (package(word__document=MAIN.format("x"), zeros="0" * 50_000), "DOCX expands too far"),
    ],
)
def test_docx_integrity(content, problem):
    assert files.docx_problem(content, 20_000) == problem


def test_newest_and_versions(spark, tmp_path):
    path, schema = str(tmp_path / "trees"), "document_id int, version_id int, created_at int, tree string"
    artefacts.append(spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 1, "b")], schema), path)
    artefacts.append(spark.createDataFrame([(1, 1, 5, "c")], schema), path)
    assert {(r.version_id, r.tree) for r in artefacts.newest(spark, path).collect()} == {(1, "c"), (2, "b")}
    assert [r.tree for r in artefacts.of_version(spark, path, 1, 1).collect()] == ["c", "a"]


def test_readiness_and_restore(spark):
    key = "document_id int, version_id int"
    v = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], key)
    c = spark.createDataFrame([(1, 1, "a", 2), (1, 1, "b", 2), (2, 1, "c", 1)], f"{key}, chunk_id string, n_declared int")
    kind = "status string, model string, model_version string, dimension int"
    e = spark.createDataFrame([(1, 1, "a", "ea", "ACTIVE", "m", "1", 2), (1, 1, "b", "eb", "ACTIVE", "m", "1", 2), (2, 1, "c", "ec", "STALE", "m", "1", 2)], f"{key}, chunk_id string, embedding_id string, {kind}")
    found = artefacts.version_problems(v, v, v.where("document_id < 3"), c, e, e, "m", "1", 2)
    got = {r.document_id: r.problems for r in found.collect()}
    assert got == {1: "", 2: "vectors don't cover the chunks; index doesn't cover the vectors", 3: "no tree; no chunks; vectors don't cover the chunks; index doesn't cover the vectors"}
    docs = spark.createDataFrame([(1, 1, "ARCHIVED"), (2, 1, "ARCHIVED"), (3, 1, "ACTIVE"), (4, 1, "ARCHIVED")], f"{key}, status string")
    out = {r.document_id: (r.status, r.restored, r.reason) for r in artefacts.restored(docs, found).collect()}
    assert out[1] == ("ACTIVE", True, None) and out[2][:2] == ("ARCHIVED", False) and out[3] == ("ACTIVE", False, "not archived") and out[4][2] == "no artefacts"


def test_requeue_and_assign(spark):
    states = spark.createDataFrame([(1, "FAILED"), (2, "FAILED"), (3, "READY")], "document_id int, state string")
    jobs = spark.createDataFrame([(1, "FAILED"), (2, "RUNNING")], "document_id int, last_status string")
    assert [tuple(r) for r in artefacts.requeued(states, jobs).collect()] == [(1, "UPLOADED")]
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "document_id int, vault_id string")
    events = spark.createDataFrame([(1, 1, "b"), (1, 2, None), (2, 1, "c")], "document_id int, seq int, vault_id string")
    assert {tuple(r) for r in artefacts.assigned(docs, events).collect()} == {(1, None), (2, "c"), (3, "a")}


def test_reprocess(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "document_id int, x string")
    tables = {"files": rows((1, "f"), (2, "f")), "lines": rows((1, "l"), (2, "l")), "nodes": rows((1, "n"), (2, "n")), "embeddings": rows((1, "v"), (2, "v")), "entries": rows((1, "i"), (2, "i"))}
    builders = {t: (lambda df, t=t: df.select("document_id", F.concat("x", F.lit(t[0].upper())).alias("x"))) for t in ("lines", "nodes", "embeddings", "entries")}
    out = admin.reprocess("parse", tables, builders, rows((2, "")))
    got = {t: {tuple(r) for r in df.collect()} for t, df in out.items()}
    assert got["lines"] == {(1, "l"), (2, "l")} and got["nodes"] == {(1, "n"), (2, "lN")} and got["entries"] == {(1, "i"), (2, "lNEE")}


def test_reports_and_audit(spark, tmp_path):
    report = spark.createDataFrame([("retrieval", "recall", 0.25), ("citation", "f1", None)], "component string, metric string, value double")
    files.write_report(report, str(tmp_path / "report"))
    assert {tuple(r) for r in files.read_report(spark, str(tmp_path / "report")).collect()} == {("retrieval", "recall", 0.25), ("citation", "f1", None)}
    event = spark.sql("SELECT 'vault' AS service, 'create' AS event, 'vault' AS entity_type, '1' AS entity_id, 'INFO' AS severity, 'made' AS message, timestamp'2024-01-02 03:04:05' AS at")
    for _ in range(2):
        files.append_audit(event, str(tmp_path / "audit"))
    assert [str(r.day) for r in files.read_audit(spark, str(tmp_path / "audit")).collect()] == ["2024-01-02"] * 2


def test_generation_hook(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id int")
    prompts = spark.createDataFrame([(1, "ask"), (2, "fail"), (3, "none")], "query_id int, prompt string")
    template = spark.createDataFrame([(1, "t1"), (2, "t2"), (3, "t3")], "query_id int, content string")

    def model(prompt):
        if prompt == "fail":
            raise RuntimeError("down")
        return "The evidence is insufficient." if prompt == "none" else "said"

    got = {r.query_id: (r.content, r.status) for r in admin.generated(queries, prompts, template, model).collect()}
    assert got == {1: ("said", "SUCCESS"), 2: ("t2", "SUCCESS"), 3: (admin.NO_EVIDENCE, "NO_EVIDENCE"), 4: (admin.NO_EVIDENCE, "NO_EVIDENCE")}
    assert {r.content for r in admin.generated(queries.where("query_id < 3"), prompts, template).collect()} == {"t1", "t2"}


def test_registering(spark):
    rows = spark.createDataFrame([("c1", "a", True), ("c1", "b", True), ("c2", "x", True), ("c3", "y", False)], "checksum string, stored_name string, accepted boolean")
    assert [(r.checksum, r.title) for r in files.new_documents(rows, rows.where("checksum = 'c2'")).collect()] == [("c1", "a")]


def test_json_tags(spark):
    rows = spark.createDataFrame([('["a, b", " A,  B", null, "c"]',), ("[x, y",), ("d\ne",), (None,)], "t string")
    assert [r[0] for r in rows.select(tx.normalised_tags("t")).collect()] == [["a, b", "c"], ["[x", "y"], ["d", "e"], []]


def test_verdicts(spark):
    rows = spark.createDataFrame([(1, 1.0, 1.0, 5, False, False), (2, 0.2, 0.1, 5, False, False), (3, 1.0, 1.0, 5, False, True), (4, 1.0, 0.2, 0, True, True)], "answer_id int, recall double, precision double, n_chars int, abstained boolean, should_abstain boolean")
    found = evaluation.case_verdicts(rows)
    assert {r.answer_id: r.failure for r in found.collect()} == {1: None, 2: "RETRIEVAL", 3: "GENERATION", 4: "CITATION"}
    assert {r.component: (r.n_passed, r.pass_rate) for r in evaluation.component_report(found).collect()}["pipeline"] == (1, 0.25)
