"""Exact neighbours by blocks against scores of every pair; quantiles by ranges against sorted lists; runs of words in linear time."""

import math
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.functions import text as tx
from tesserae.operators import nearest, observability, retrieval
from tesserae.plans import citation as pc


def rows(seed, n, dims=(5, 3)):
    """Vectors with repeats, zeros, near ties, nulls, odd lengths."""
    draw, out = random.Random(seed), []
    for i in range(n):
        d = dims[i % 9 == 0]
        v = [draw.choice([0.0, 1.0, -1.0, draw.gauss(0, 1), 1e-3]) for _ in range(d)]
        out.append((i, out[draw.randrange(i)][1] if i and i % 7 == 0 else [x * draw.choice([1, 1, 1e4]) for x in v]))
    return out + [(n, None), (n + 1, []), (n + 2, [1.0, None, 1.0, 1.0, 1.0]), (n + 3, [math.nan] * 5), (n + 4, [0.0] * 5)]


def plain(entries, queries, metric, k, threshold):
    usable = lambda v: bool(v) and all(x is not None and math.isfinite(x) for x in v)
    out = {}
    for q, a in queries:
        found = []
        for e, b in entries:
            if not usable(a) or not usable(b) or len(a) != len(b):
                continue
            x, y = np.array(a)[None], np.array(b)[None]
            s = float(nearest.exact(x, y, metric)[0])
            if threshold is None or s >= threshold:
                found.append((-round(s, 6), e))
        if found:
            out[q] = sorted(found)[:k]
    return out


@pytest.mark.parametrize("metric", nearest.METRICS)
@pytest.mark.parametrize("small", [True, False])
def test_neighbours(spark, monkeypatch, metric, small):
    monkeypatch.setattr(nearest, "ENTRY_BLOCK", 16)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 4)
    monkeypatch.setattr(retrieval, "is_small", lambda df: small)
    entries, queries = rows(1, 120), rows(2, 20)
    e = spark.createDataFrame(entries, "entry_id long, vector array<double>").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, q_vector array<double>").repartition(2)
    for threshold in (None, 0.3):
        got: dict = {}
        for r in retrieval.knn(e, q, metric, 6, threshold).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((-r.score, r.entry_id))
        want = plain(entries, queries, metric, 6, threshold)
        assert {k: [i for _, i in v] for k, v in got.items()} == {k: [i for _, i in v] for k, v in want.items()}
        assert all(abs(a - b) < 2e-6 * max(1, abs(b)) for k in want for (a, _), (b, _) in zip(got[k], want[k], strict=True))


def test_all_ties_go_by_id(spark):
    e = spark.createDataFrame([(f"e{i:03}", [1.0, 0.0]) for i in range(200)], "entry_id string, vector array<float>")
    q = spark.createDataFrame([(1, [2.0, 0.0])], "query_id long, q_vector array<float>")
    assert [r.entry_id for r in retrieval.knn(e, q, "cosine", 5).orderBy("rank").collect()] == [f"e{i:03}" for i in range(5)]
    assert retrieval.knn(e.limit(0), q, "dot", 5).count() == retrieval.knn(e, q.limit(0), "dot", 5).count() == 0


def meeting(q, e):
    """A query block and an entry block as they meet in a task."""
    listed = lambda n: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(range(n), pa.int64()))
    binary = lambda x: pa.array([x.tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([q.shape[1]], pa.int32()), listed(len(e)), binary(e), listed(len(q)), binary(q)], names=["dim", "ids", "vectors", "qids", "qvectors"])


@pytest.mark.parametrize("metric", nearest.METRICS)
def test_memory_of_a_meeting(metric):
    """Full blocks meet: scores of a slice of the queries are held, not of all (17 MB for each table of 512 x 4096 scores)."""
    draw = np.random.default_rng(3)
    batch = meeting(draw.normal(size=(nearest.QUERY_BLOCK, 16)), draw.normal(size=(nearest.ENTRY_BLOCK, 16)))
    run = nearest._first(metric, 10, None, 1e-6)
    tracemalloc.start()
    n = sum(b.num_rows for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n >= 10 * nearest.QUERY_BLOCK and peak < 12 << 20


@pytest.mark.parametrize("metric", nearest.METRICS)
def test_few_copies_leave_a_meeting(metric):
    """Of thousands of equal entries the first ids leave, in number of k for each query and score."""
    q = np.array([[1.0, 0.0], [0.0, 0.0], [0.0, 2.0]])
    e = np.tile(np.array([[1.0, 0.0], [0.0, 1.0]]), (1500, 1))
    found = [r for b in nearest._first(metric, 4, None, 1e-6)(iter([meeting(q, e)])) for r in b.to_pylist()]
    assert len(found) <= len(q) * 2 * 4
    assert sorted(r["entry_id"] for r in found if r["query_id"] == 0) == [0, 2, 4, 6]


def test_quantiles_of_a_hot_metric(spark):
    """A metric with nearly all rows, one with a row, one of nulls alone, a null name; values with many repeats."""
    draw = random.Random(4)
    data = [("hot", float(draw.choice([1, 2, 3, draw.randrange(1000)]))) for _ in range(5000)] + [("one", 7.5)] + [("none", None)] * 3 + [(None, 2.0), (None, 4.0)] + [("few", float(i)) for i in range(1, 21)] + [("hot", None)] * 5
    df = spark.createDataFrame(data, "name string, value double").repartition(6)
    got = {r.name: r for r in observability.histograms(df, ["name"]).collect()}
    for name in {n for n, _ in data}:
        values, r = sorted(v for n, v in data if n == name and v is not None), got[name]
        assert r.n == sum(n == name for n, _ in data)
        if not values:
            assert (r.p50, r.p95, r.p99, r.sum) == (None, None, None, None)
            continue
        at = lambda p: values[math.ceil(round(p * len(values), 9)) - 1]  # noqa: B023, E731
        middle = (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2
        assert (r.p50, r.p95, r.p99) == (round(middle, 2), at(0.95), at(0.99)), name
    plan = observability.histograms(df, ["name"])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan.lower()


def test_quantiles_without_rows(spark):
    assert observability.histograms(spark.createDataFrame([], "name string, value double"), ["name"]).count() == 0


def test_places_of_dates(spark):
    text = "từ ngày 1 tháng 2 năm 2024 đến 03/04/2025, 03/04/2025 và ngày 05 tháng 06 năm 2026."
    r = spark.range(1).select(tx.date_mentions(F.lit(text)).alias("d"), tx.mention_starts(F.lit(text), tx.DATES).alias("s")).first()
    assert len(r.d) == len(r.s) == 4 and all(text[s : s + len(d)] == d for d, s in zip(r.d, r.s, strict=True)) and len(set(r.s)) == 4
    assert spark.range(1).select(tx.mention_starts(F.lit("none"), tx.DATES)).first()[0] == []


def test_runs_of_words_in_linear_time(spark):
    """Twice the words are about twice the work, not four times."""

    def took(n):
        texts = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "document_id long, text string").coalesce(1)
        asked = spark.createDataFrame([(1, "w3 w4 w5 w6 w7 w8 w9")], "query_id long, query string")
        pc.holding(texts, asked).collect()  # compiled
        began = time.perf_counter()
        assert [tuple(r) for r in pc.holding(texts, asked).collect()] == [(1, 1)]
        return time.perf_counter() - began

    base = took(5_000)
    assert took(40_000) < 16 * base + 2
