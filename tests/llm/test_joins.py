"""Plans whose sides must not grow in the driver, and Arrow batches that must not grow with the tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm import ann, components, ngram_join


def test_lead_tables_are_never_broadcast(spark):
    """A table that is repeated for each salt looks as small to the planner as before: it must not be broadcast, and only salts in use are made."""
    rows = spark.range(300).select((F.col("id") % 3).alias("lead"), F.col("id").alias("member"))
    table = spark.range(2).select(F.col("id").alias("lead"), F.lit(1).alias("blocks"))
    found = ngram_join._by_lead(rows, table)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in found.select("lead", "member", "blocks").collect()) == sorted((i % 3, i, 1) for i in range(300) if i % 3 < 2)


def below(plan, name):
    """The parts of a plan below each node of this name."""
    lines = plan.split("\n")
    deep = [len(x) - len(x.lstrip(" :+-*()0123456789")) for x in lines]
    for i, line in enumerate(lines):
        if line[deep[i] :].startswith(name):
            end = next((j for j in range(i + 1, len(lines)) if deep[j] <= deep[i]), len(lines))
            yield "\n".join(lines[i:end])


def test_near_duplicates_broadcast_no_repeated_table(spark, docs, monkeypatch):
    """The pipeline's stage over groups of near copies: what it broadcasts are tables as they are, none that a sequence has multiplied."""
    plans, write = {}, ngram_join.staged

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(ngram_join, "staged", kept)
    assert 0 < corpus_pipeline.near_duplicates(spark, docs, "").count() < docs.count()
    assert {"stars", "open", "groups"} <= set(plans)
    for name, plan in plans.items():
        repeated = ("Generate explode(sequence", "Generate explode(org.apache.spark.sql.catalyst.expressions.UnsafeArrayData")
        assert not [x for x in below(plan, "BroadcastExchange") if any(r in x for r in repeated)], name


def test_near_duplicates_broadcast_no_table_that_grows(spark, docs, monkeypatch):
    """Small files don't make a small broadcast: no side of the stage's joins is broadcast, neither on the way nor at the end."""
    plans, write = {}, ngram_join.staged

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(ngram_join, "staged", kept)
    plans["kept"] = corpus_pipeline.near_duplicates(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert {"groups", "stars", "open", "least", "named", "judged", "kept"} <= set(plans)
    assert [name for name, plan in plans.items() if "Broadcast" in plan] == []


def test_components_broadcast_only_few_edges(spark, monkeypatch):
    """Rounds over more edges than a file holds merge their sides; components stay the same."""
    edges = spark.createDataFrame([(i, i + 3) for i in range(30)] + [(100, 101)], "a long, b long")
    few = sorted(map(tuple, components.components(edges).collect()))
    plans, write = [], components.staged

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(components, "staged", kept)
    monkeypatch.setattr(components, "PER_FILE", 20)
    assert sorted(map(tuple, components.components(edges).collect())) == few == [*[(i, i % 3) for i in range(3, 33)], (101, 100)]
    assert plans and not [x for x in plans if "Broadcast" in x]


def test_each_shortlist_leaves_its_cell_once():
    """Many more query blocks than HELD in a cell: a list was given anew for each meeting, and all of a query block's lists were gathered in one row."""
    draw = np.random.default_rng(5)
    x = draw.normal(size=(900, 8)).astype(np.float32)
    books = ann.train(x, books=4, words=8)
    codes, norms = ann.encode(x, books)
    ids = np.arange(900)
    n = 3 * ann.HELD
    rows = [{"g": 0, "part": 0, "kind": 0, "ids": ids[4 * i : 4 * i + 4].tobytes(), "places": ids[4 * i : 4 * i + 4].tobytes(), "codes": None, "norms": None, "vectors": x[4 * i : 4 * i + 4].tobytes()} for i in range(n)]
    for part in (0, 1):
        rows += [{**r, "part": 1} for r in rows[:n]] if part else []
        for a in range(450 * part, 450 * part + 450, 90):
            cut = slice(a, a + 90)
            rows.append({"g": 0, "part": part, "kind": 1, "ids": ids[cut].tobytes(), "places": ids[cut].tobytes(), "codes": codes[cut].astype(np.uint8).tobytes(), "norms": norms[cut].tobytes(), "vectors": None})
    kinds = {"g": pa.int32(), "part": pa.int32(), "kind": pa.int32()}
    schema = pa.schema([(c, kinds.get(c, pa.binary())) for c in rows[0]])
    out = list(ann._shortlists(books, np.dtype(np.float32), 1e-6, 20)(iter([pa.RecordBatch.from_pylist(rows, schema)])))
    assert sum(b.num_rows for b in out) == 2 * n
    lists = pa.Table.from_batches(out).sort_by("q_ids")
    found = pa.Table.from_batches(ann._pairs(20)(iter(lists.to_batches(max_chunksize=3)))).to_pylist()
    got = {q: [r["row"] for r in found if r["query_id"] == q] for q in range(4 * n)}
    keys = np.rint(ann.scores(x[: 4 * n], codes, norms, books) / 1e-6).astype(np.int64)
    assert got == {q: [int(i) for i in np.lexsort((ids, keys[q])) if i != q][:20] for q in got}
