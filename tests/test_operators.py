"""Scores, gates, metrics, registry folds, sources and streams on small inputs."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tesserae.functions import text as tx
from tesserae.functions import vectors
from tesserae.operators import evaluation, lifecycle, observability, registry, retrieval
from tesserae.sources import files
from tesserae.streaming import ingest


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_query_terms(spark):
    r = one(spark, F.sort_array(tx.query_terms(F.lit("Múi giờ của mẫu 4A và 5A năm 2024"))), F.sort_array(tx.document_codes(F.lit("mẫu 4A và 5A, ngày 12 năm 2024"))))
    assert r[0] == ["2024", "4a", "5a", "gmt"] and r[1] == ["2024", "4a", "5a"]


def test_match_score(spark):
    s = lambda a, b: one(spark, tx.match_score(F.lit(a), F.lit(b)))[0]
    assert (s("A b", "a B"), s("a b", "x a b y"), s("x a b", "a b"), s("là một a b", "b c"), s("", "a"), s("là", "một c")) == (1.0, 0.9, 0.8, 0.5, 0.0, 0.0)


def test_claims(spark):
    r = one(spark, tx.claim_type(F.lit("Theo Điều 3")), tx.claim_type(F.lit("A phải nộp thuế")), tx.claim_type(F.lit("X 2024-01-02")), tx.legal_references(F.lit("Điều 3 Khoản 2 Điểm a")))
    assert r[0] == "LEGAL_REFERENCE" and r[1] == "LEGAL_REQUIREMENT" and r[2] == "DATE"
    assert r[3] == ["Điều 3 Khoản 2 Điểm a", "Khoản 2 Điểm a", "Điểm a"]


def test_similarities(spark):
    a, z = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    r = one(spark, vectors.cosine(a, a), vectors.cosine(a, z), vectors.dot(a, a), vectors.euclid(a, z), vectors.cosine(a, F.array(F.lit(1.0))))
    assert tuple(round(x, 9) for x in r) == (1.0, 0.0, 25.0, round(1 / 6, 9), 0.0)
    with pytest.raises(ValueError):
        retrieval.knn(spark.range(1), spark.range(1), "manhattan")


def test_many_queries_meet_slices(spark, sf_dir, monkeypatch):
    from tesserae.plans import retrieval as plans

    rows = lambda: sorted(map(tuple, plans.knn("cosine")(spark, sf_dir).collect()))
    hits = lambda: sorted(map(tuple, plans.keyword_search(spark, sf_dir).collect()))
    before = rows(), hits()
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", -1)
    assert (rows(), hits()) == before


def test_fusion(spark):
    schema = "query_id int, entry_id int, score double, rank int"
    s, w = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.5, 2), (2, 1, 0.7, 1)], schema), spark.createDataFrame([(1, 2, 1.0, 1)], schema)
    got = {(r.query_id, r.entry_id): r.score for r in retrieval.fuse(s, w).collect()}
    rrf = lambda *ranks: min(1.0, sum(1 / (60 + r) for r in ranks) / (2 / 61))
    assert got == {(1, 1): round(0.95 * 0.9 + 0.05 * rrf(1), 4), (1, 2): round(0.75 * 0.5 + 0.15 + 0.1 * rrf(2, 1), 4), (2, 1): 0.7}


def test_evidence_gate(spark):
    rows = [(1, "penalty for delay", "generic text", "", 0.69), (2, "penalty for delay", "generic text", "", 0.76), (3, "compare 4A and 5A", "generic", "Form 4A", 0.74), (4, "anything", "other", "", 0.8), (5, "penalty delay", "delay is fined", "", 0.73)]
    out = retrieval.evidence_gate(spark.createDataFrame(rows, "id int, query string, text string, title string, score double"))
    assert {r.id for r in out.collect()} == {3, 4, 5}


def test_confidence(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.8), (2, 0.9), (3, 0.2), (4, None)], "q int, score double")
    assert {r.q: r.level for r in retrieval.confidence(rows, ["q"]).collect()} == {1: "HIGH", 2: "MEDIUM", 3: "LOW", 4: "LOW"}


def test_metrics(spark):
    c = F.lit
    r = one(spark, evaluation.recall(c(3), c(5), 10), evaluation.precision(c(3), 10), evaluation.recall(c(0), c(0), 0), evaluation.recall(c(1), c(2), 0), evaluation.f1(c(0.5), c(1.0)))
    assert tuple(round(x, 6) for x in r) == (0.6, 0.3, 1.0, 0.0, round(2 / 3, 6))
    graded = spark.createDataFrame([(1, 1, 3.0), (1, 2, 2.0), (1, 3, 1.0), (2, 1, 0.0)], "query_id int, rank int, relevance double")
    assert {x.query_id: x.ndcg for x in evaluation.ndcg(graded, 3).collect()} == {1: 1.0, 2: 0.0}
    ranks = spark.createDataFrame([(1.0,), (0.5,), (1 / 3,)], "reciprocal_rank double")
    assert evaluation.mean_reciprocal_rank(ranks).first().mrr == round(11 / 18, 6)


def test_regressions(spark):
    base = spark.createDataFrame([("r", "pass_rate", 0.8), ("r", "mrr", 0.5)], "component string, metric string, value double")
    now = spark.createDataFrame([("r", "pass_rate", 0.6), ("r", "mrr", 0.9), ("r", "new", 0.1)], "component string, metric string, value double")
    assert {r.metric: r.status for r in evaluation.regressions(base, now).collect()} == {"pass_rate": "REGRESSION", "mrr": "IMPROVEMENT", "new": "UNCHANGED"}


def test_histogram(spark):
    r = observability.histograms(spark.range(1, 11).selectExpr("'m' AS name", "double(id) AS value"), ["name"]).first()
    assert (r.p50, r.p95, r.p99, r.n, r.avg) == (5.5, 10.0, 10.0, 10, 5.5)


def test_alerts(spark):
    values = spark.createDataFrame([("retrieval.latency_ms", 2500.0), ("citation.coverage", 0.4), ("other", 1.0)], "metric string, value double")
    fired = {r.rule: r.message for r in observability.alerts(values, observability.rules(spark)).collect()}
    assert fired == {"search_latency_warning": "Search latency 2500.0ms exceeds 2000.0ms threshold", "citation_coverage_low": "Citation coverage 0.4 is below 0.5 threshold"}


def test_states(spark):
    rows = [(1, 1, "UPLOADED"), (1, 2, "OCR_PENDING"), (1, 3, "READY"), (1, 4, "ARCHIVED"), (2, 1, "READY")]
    got = {(r.document_id, r.seq): r.valid for r in lifecycle.checked_transitions(spark.createDataFrame(rows, "document_id long, seq long, state string")).collect()}
    assert got == {(1, 1): True, (1, 2): True, (1, 3): False, (1, 4): True, (2, 1): False}


def test_metadata_patch(spark):
    docs = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, {"c": "3"})], "document_id int, metadata map<string,string>")
    patch = spark.createDataFrame([(1, 1, {"b": "x"}), (1, 2, {"b": "y", "d": "4"})], "document_id int, at int, metadata map<string,string>")
    assert {r.document_id: r.metadata for r in registry.merge_metadata(docs, patch).collect()} == {1: {"a": "1", "b": "y", "d": "4"}, 2: {"c": "3"}}


def test_tags(spark):
    tags = one(spark, tx.normalised_tags(F.lit(" Luật  A, luật a\nB,, " + "x" * 65)))[0]
    assert tags == ["Luật A", "B"]


def docx(lines):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_docx_source(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(["Điều 1. Phạm vi áp dụng của văn bản này đối với tổ chức", " ", "Nội dung"]))
    (tmp_path / "b.docx").write_bytes(b"PK\x03\x04broken")
    (tmp_path / "c.txt").write_bytes(b"plain")
    rows = {r.document_id.rsplit("/")[-1]: r for r in files.extract_lines(files.read_files(spark, str(tmp_path))).collect()}
    assert [x.text for x in rows["a.docx"].lines][1] == "Nội dung" and rows["a.docx"].error is None and not rows["a.docx"].needs_ocr
    assert rows["b.docx"].error and rows["b.docx"].lines == [] and "no extractor" in rows["c.txt"].error
    flat = files.flat_lines(files.extract_lines(files.read_files(spark, str(tmp_path))))
    assert files.page_confidence(flat).first().page_confidence == 1.0 and files.has_text(flat).count() == 1


def test_upload_gate_and_store(spark, tmp_path):
    rows = [("~$x.docx", docx(["a"])), ("x.exe", b"1"), ("x.pdf", b"%PDF-1"), ("y.pdf", b"no"), ("a b.docx", docx(["a"])), ("c.docx", docx(["a"])), ("z.pdf", b"")]
    out = files.upload_gate(spark.createDataFrame([(n, bytearray(c)) for n, c in rows], "filename string, content binary"))
    assert [r.reject_reason for r in out.collect()] == ["lock file", "unsupported type", None, "not a PDF", None, None, "empty file"]
    assert out.where("filename = 'a b.docx'").first().stored_name == "a_b_docx"
    files.store(out, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2


def test_stream_ingest(spark, tmp_path):
    spark.range(10).selectExpr("id AS doc_id", "concat('text ', id) AS text").write.parquet(str(tmp_path / "in"))
    stream = ingest.documents(spark, str(tmp_path / "in"), "doc_id long, text string")
    for _ in range(2):  # a second run finds nothing new
        ingest.process(stream, lambda df: df.select("doc_id", tx.token_estimate("text").alias("tokens")), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_stream_states(spark, tmp_path):
    rows = [(1, 1, "UPLOADED"), (1, 2, "READY"), (2, 1, "UPLOADED"), (2, 2, "OCR_PENDING")]
    spark.createDataFrame(rows, "document_id long, seq long, state string").write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("document_id long, seq long, state string").parquet(str(tmp_path / "in"))
    query = ingest.checked_states(events).writeStream.format("memory").queryName("states").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.document_id, r.seq): r.valid for r in spark.table("states").collect()} == {(1, 1): True, (1, 2): False, (2, 1): True, (2, 2): True}
