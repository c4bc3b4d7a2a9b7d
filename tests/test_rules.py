"""Rules of single operators by cases made by hand."""

from pyspark.sql import functions as F

from tesserae.operators import admin, chunking, citation, retrieval, structure
from tesserae.plans.citation import holding


def test_prompt(spark):
    rows = [(1, 1, 7, "Luật A", "Điều 2", "một"), (1, 2, 8, None, None, "hai"), (2, 1, 9, "", "", None)]
    got = {r.query_id: r.prompt for r in admin.evidence_prompt(spark.createDataFrame(rows, "query_id int, rank int, document_id int, title string, label string, text string")).collect()}
    assert got[1] == "[Nguồn 1]\nTài liệu: Luật A\nVị trí: Điều 2\nNội dung:\nmột\n\n---\n\n[Nguồn 2]\nTài liệu: Document 8\nVị trí: Source 2\nNội dung:\nhai"
    assert got[2] == "[Nguồn 1]\nTài liệu: \nVị trí: Source 1\nNội dung:\n"


def test_pages_of_sections(spark):
    """A preamble ends on the page of the heading that ends it, on the line before; the last one on the last line."""
    texts = ["Mở đầu", "và tiếp", "Điều 1. Một", "thân", "1. khoản"]
    rows = [(1, 1 + i // 2, i + 1, t) for i, t in enumerate(texts)] + [(2, 1, 1, "chỉ có chữ"), (2, 3, 9, "và hết")]
    found = structure.sections(structure.classify(spark.createDataFrame(rows, "document_id int, page_number int, line_no int, text string")))
    got = [(r.document_id, r.type, r.page_start, r.page_end, r.line_start, r.line_end) for r in found.orderBy("document_id", "ord").collect()]
    assert got == [(1, "PREAMBLE", 1, 2, 1, 2), (1, "ARTICLE", 2, 2, 3, 3), (1, "CLAUSE", 3, 3, 5, 5), (2, "PREAMBLE", 1, 3, 1, 9)]
    assert {r.document_id: r.last_page for r in structure.statistics(structure.hierarchy(found)).collect()} == {1: 3, 2: 3}


def test_short_reference(spark):
    rows = [(1, 1, "ARTICLE", "Điều 3", "", 0, 0, 1), (1, 2, "TABLE", "Bảng giá", "x", 0, 1, 1), (1, 3, "TABLE", None, "x", 0, 2, 1)]
    nodes = spark.createDataFrame(rows, "document_id int, ord int, type string, title string, text string, parent int, sibling int, depth int")
    assert [r.short_reference for r in structure.references(nodes).orderBy("ord").collect()] == ["Điều 3", "Bảng giá", ""]


def test_second_roots_and_children(spark):
    rows = [(1, 0, -1, 0, "", "1", [1, 2, 9]), (1, 1, 0, 0, "a", "1.1", [2]), (1, 2, 0, 1, "b", "1.2", []), (1, 3, None, 0, "c", "1.3", [])]
    nodes = spark.createDataFrame(rows, "document_id int, ord int, parent int, sibling int, reference string, path string, children array<int>")
    assert {(r.ord, r.problem) for r in structure.violations(nodes).collect()} == {(3, "second_root"), (0, "missing_child"), (1, "child_of_another")}


def test_traceability(spark):
    cited = [(1, 1, 5, "v5a", 1), (1, 2, 5, "v5b", 2), (1, 3, 5, "v5a", 2), (1, 4, 5, "v5c", 1), (1, 5, 6, "v6", 1), (1, 6, 5, "v5a", 9), (1, 7, 5, "v5a", 1)]
    schema = "answer_id int, evidence_id int, document_id int, version_id string, node_id int"
    own = [r if r[1] != 3 else (1, 3, 5, "v5a", 1) for r in cited if r[1] != 7]
    versions = spark.createDataFrame([(5, "v5a"), (5, "v5b")], "document_id int, version_id string")
    nodes = spark.createDataFrame([("v5a", 1), ("v5b", 2)], "version_id string, node_id int")
    out = citation.traceability(spark.createDataFrame(cited, schema), spark.createDataFrame(own, schema), versions, nodes).collect()
    assert len(out) == 7 and {r.evidence_id: r.error for r in out} == {1: None, 2: None, 3: "disagrees_with_evidence", 4: "missing_version", 5: "missing_document", 6: "missing_node", 7: "no_matching_evidence"}


def test_threshold_is_for_raw_scores(spark):
    entries = spark.createDataFrame([(1, [0.29999999, 0.0]), (2, [0.30000001, 0.0])], "entry_id int, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, q_vector array<double>")
    assert [(r.entry_id, r.score) for r in retrieval.knn(entries, asked, "dot", threshold=0.3).collect()] == [(2, 0.3)]


def test_holding(spark):
    texts = [(1, "xone two three four five six seveny"), (2, "one two three four five six"), (3, "a short one here"), (4, None), (5, "one  two three four five six seven")]
    asked = [(1, "one two three four five six seven"), (2, "short one"), (3, None), (4, "nowhere at all")]
    found = holding(spark.createDataFrame(texts, "document_id int, text string"), spark.createDataFrame(asked, "query_id int, query string"))
    assert {tuple(r) for r in found.collect()} == {(1, 1), (2, 3)}


def test_context_of_neighbouring_hits(spark):
    chunks = spark.createDataFrame([(1, i, f"1:{i}") for i in range(6)], "document_id int, ord int, entry_id string")
    hits = spark.createDataFrame([(1, 1, 2, 0.5), (1, 1, 3, 1.0)], "query_id int, document_id int, ord int, score double")
    assert {(r.entry_id, r.score) for r in retrieval.context_window(chunks, hits).collect()} == {("1:1", 0.4), ("1:4", 0.8)}


def test_split_rule():
    text = "aaaa bbbb. cccc dddd\n\neeee, ffff gggghhhhiiiijjjjkkkk"
    assert chunking.split_text(text, 22) == ["aaaa bbbb. cccc dddd", "eeee, ffff gggghhhhiii", "ijjjjkkkk"]  # the blank before g is in the first half
    assert chunking.split_text("x" * 25 + "  ", 10) == ["x" * 10, "x" * 10, "x" * 5] and chunking.split_text("  ", 5) == [] and chunking.split_text(None, 5) == []
    assert max(map(len, chunking.split_text("word " * 50_000, 4096))) <= 4096


def test_query_side_beyond_a_broadcast(spark, monkeypatch):
    entries = spark.createDataFrame([(i, f"alpha beta{i % 3}", "title alpha") for i in range(30)], "entry_id int, content string, title string")
    asked = spark.createDataFrame([(1, "alpha beta1"), (2, "beta2 gamma")], "query_id int, query string")
    plain = {tuple(r) for r in retrieval.keyword_hits(entries, asked).collect()}
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", -1)
    assert {tuple(r) for r in retrieval.keyword_hits(entries, asked).collect()} == plain and len(plain) == 40


def test_streamed_groups(spark, tmp_path):
    from tesserae.streaming import ingest

    spark.createDataFrame([("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 00:20:00", 2.0)], "event_type string, ts string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    for more in ((), [("a", "2024-01-01 00:30:00", 4.0), ("b", "2024-01-01 01:30:00", 8.0)]):
        if more:
            spark.createDataFrame(more, "event_type string, ts string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.updated(ingest.windowed_metrics(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(r.event_type, r.n, r.total) for r in ingest.newest(spark, str(tmp_path / "out"), ["event_type", "start"]).collect()}
    assert got == {("a", 3, 7.0), ("b", 1, 8.0)}
