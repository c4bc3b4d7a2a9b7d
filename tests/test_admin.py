"""Administrative folds and hooks that have no query of their own."""

import base64

import pytest
from pyspark.sql import functions as F

from tesserae.operators import admin, lifecycle, registry, retrieval


def test_strategies(spark):
    rows = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.5, 2)], "query_id int, entry_id int, score double, rank int")
    assert admin.search("SEMANTIC", rows, rows.limit(0), 1).count() == 1 and admin.search("HYBRID", rows, rows.limit(0)).first().score == 0.9
    with pytest.raises(ValueError):
        admin.search("OTHER", rows, rows)


def test_embed_hook(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "id int, text string")
    got = {r.id: r.vector for r in admin.embed(rows, lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()}
    assert got == {1: [2.0, 1.0], 2: None, 3: None}


def test_upload_payloads(spark):
    raw = base64.b64encode(b"abc").decode()
    rows = spark.createDataFrame([(raw,), (f"data:application/pdf;base64,{raw}",)], "data string")
    assert [bytes(r.content) for r in admin.decoded_upload(rows).collect()] == [b"abc", b"abc"]


def test_vaults(spark):
    events = spark.createDataFrame([(1, 1, "CREATE", "a"), (1, 2, "ARCHIVE", None), (1, 3, "ARCHIVE", None), (2, 1, "CREATE", "b"), (2, 2, "RENAME", "c")], "vault_id int, seq int, action string, name string")
    assert {tuple(r) for r in admin.vault_states(events).collect()} == {(1, "ARCHIVED", "a", 1), (2, "ACTIVE", "c", 0)}
    vaults = spark.createDataFrame([(1, "user-2", {"user-1": "VIEWER"}), (2, "user-3", {"user-10": "VIEWER"})], "id int, owner string, members map<string,string>")
    assert [r.id for r in admin.member_of(vaults, "user-1").collect()] == [1]


def test_reprocess_and_flags(spark):
    assert admin.reprocessed("embed") == ["embeddings", "entries"] and admin.reprocessed("ocr")[0] == "lines"
    rows = spark.createDataFrame([(True, True, None), (True, True, True)], "a boolean, b boolean, c boolean")
    assert [r.ready for r in admin.flags_ready(rows, ["a", "b", "c"]).collect()] == [False, True]
    assert [r.ready for r in admin.flags_ready(rows, ["a", "b", "c"], 2).collect()] == [True, True]


def test_highlight_and_acknowledge(spark):
    assert spark.range(1).select(admin.highlighted(F.lit("Điều 1 (a.b)"), ["điều", "a.b"])).first()[0] == "<mark>Điều</mark> 1 (<mark>a.b</mark>)"
    alerts = spark.createDataFrame([(1,), (2,)], "alert_id int")
    assert {r.alert_id: r.acknowledged for r in admin.acknowledged(alerts, alerts.where("alert_id = 2")).collect()} == {1: False, 2: True}


def test_jobs_after_restart(spark):
    rows = spark.createDataFrame([("j1", "RUNNING"), ("j2", "COMPLETED")], "job_id string, last_status string")
    assert {r.job_id: r.last_status for r in lifecycle.recovered(rows).collect()} == {"j1": "FAILED", "j2": "COMPLETED"}


def test_index_deletes(spark):
    entries = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "entry_id int, document_id int")
    assert registry.without(entries, entries.where("document_id = 10"), "document_id").count() == 1


def test_rerank(spark):
    rows = [(1, 1, 5, 5, "Same  text", "q", None, 0.9), (1, 2, 5, 5, "same text", "q", None, 0.8), (1, 3, 6, 6, "other", "q", "Điều 1", 0.9), (1, 4, 7, 7, "weak", "q", None, 0.1)]
    df = spark.createDataFrame(rows, "query_id int, evidence_id int, document_id int, node_id int, text string, query string, reference string, score double")
    assert [(r.evidence_id, r.combined, r.reason) for r in retrieval.rerank(df).orderBy("rank").collect()] == [(3, 0.93, "top_relevance"), (1, 0.92, "relevance")]
