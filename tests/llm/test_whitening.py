"""Whitening against exact integers and a plain eigendecomposition."""

import math
import random

import numpy as np
import pytest

from tesserae.llm import whitening
from tesserae.llm.queries import QUERIES


def vectors():
    """vec_id, embedding: nulls, NaN, infinities, zeros, odd lengths, repeats, large and tiny entries, null ids."""
    draw = random.Random(5)
    rows = [(i, [draw.gauss(0, 1 + k) + (k == 2) * draw.random() for k in range(6)]) for i in range(300)]
    rows += [(i, rows[i % 7][1]) for i in range(300, 340)] + [(5, rows[9][1]), (None, rows[3][1]), (None, [0.0] * 6), (400, [-0.0] * 6), (401, [1e-9] * 6), (402, [-1e-9] * 6)]
    return rows + [(500, None), (501, []), (502, [1.0] * 5), (503, [1.0, None] + [2.0] * 4), (504, [math.nan] + [1.0] * 5), (505, [math.inf] + [1.0] * 5), (506, [1e300] * 6)]


def plain(rows, d=6):
    """Of each usable row: id, deviation; and n, V of the fit list."""
    usable = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) and abs(c) < 2**55 for c in v)]
    fit = sorted({x for _, x in usable})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    gaps = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
    return n, sums, gaps.T @ gaps / n, [(i, x, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))) for i, x in usable]


@pytest.mark.parametrize("shift", [0, 1 << 40])
def test_exact(spark, shift):
    """Far from zero too, where longs don't hold what is squared."""
    rows = [(i, v if v is None else [c if c is None else c + shift for c in v]) for i, v in vectors()]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, x string, n int").repartition(6)
    n, sums, v, usable = plain(rows)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes.T[::-1]
    out = whitening.whiten(df).collect()
    assert len(out) == 4 * len(usable) and {r["n"] for r in out} == {n}
    assert sorted((str(r["id"]), int(r["deviation"])) for r in out if r["component"] == 1) == sorted((str(i), s) for i, _, s in usable)
    by_deviation = {s: x for _, x, s in usable}
    for r in out:
        k, x = r["component"] - 1, by_deviation[int(r["deviation"])]
        white = np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)]) @ axes[k] / math.sqrt(values[k])
        assert min(abs(r["whitened"] - white), abs(r["whitened"] + white)) < 1e-6
        assert abs(r["explained"] - values[k] / v.trace()) < 1e-6 * r["explained"] and r["identity_error"] < 1e-6


def test_signs_are_one_for_all_rows(spark):
    out = whitening.whiten(spark.createDataFrame(vectors(), "vec_id long, embedding array<double>").repartition(8)).where("id < 300 AND id != 5").collect()  # 5 has two vectors
    n, sums, v, _ = plain(vectors())
    _, axes = np.linalg.eigh(v)
    for k in range(4):
        axis = axes.T[::-1][k]
        signs = {np.sign(r["whitened"] * (np.array([math.floor(256 * c) - s / n for c, s in zip(vectors()[r["id"]][1], sums, strict=True)]) @ axis)) for r in out if r["component"] == k + 1 and abs(r["whitened"]) > 1e-6}
        assert len(signs) == 1


def test_no_variance(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    out = whitening.whiten(df).collect()
    assert [(r["id"], r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in sorted(out)] == [(i, k, 1, 0, None, None, None) for i in (1, 2) for k in (1, 2)]
    line = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0])], "vec_id long, embedding array<float>")).collect()
    assert {(r["component"], r["whitened"] is None) for r in line} == {(1, False), (2, True)} and {round(r["explained"]) for r in line if r["component"] == 1} == {1}


def test_query_over_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    n, _, _, usable = plain(rows, 64)
    out = QUERIES["op11_whitening"](spark, sf_dir)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(out.dtypes)["deviation"] == "bigint" and dict(out.dtypes)["n"] == "bigint" and dict(out.dtypes)["component"] == "int"
    assert sorted((r["vec_id"], r["deviation"], r["n"]) for r in out.where("component = 3").collect()) == sorted((i, s, n) for i, _, s in usable)
