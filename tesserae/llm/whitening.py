"""Embedding whitening: the covariance by MLlib's RowMatrix over exactly centred rows, then a broadcast projection.

Entries become integers x = floor(256 * c), so that sums, centring and deviations are exact. Each distinct x vector
stands once in the fit list, of n vectors with sums S. Its rows are centred as the integers n * x - S, divided by n in one
rounding; ``computeGramianMatrix`` sums their products in the executors, the driver takes the eigenvectors of a matrix of
dimension times dimension, and these few numbers go out to whiten every row.

Defined cases: a vector that is null, or holds a null, NaN or infinite entry, takes no part; nor does one without entries,
one whose length isn't that of most vectors (ties: the longer), or one with an entry whose x is no long. A null id stays null, rows
that repeat an id or a vector each get their own result. A component without variance (rounding aside) has null
``whitened``; with no variance at all ``explained`` and ``identity_error`` are null too. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm._shared import staged

#: Steps of the integer grid in 1, components returned.
GRID, COMPONENTS = 256, 4
#: |c| from here on has no long x.
_FAR = float(1 << 55)
_HALF = 32
_OUT = "id long, component int, n long, deviation string, whitened double, explained double"


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids and x of the rows that take part, whatever their length."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column("vector")
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        entries = column.flatten().cast(pa.float64())
        values = entries.fill_null(np.nan).to_numpy(zero_copy_only=False)
        bad = ~(np.abs(values) < _FAR)
        ends = np.cumsum(sizes)
        faults = np.concatenate([[0], np.cumsum(bad)])
        use = (sizes > 0) & (faults[ends] == faults[ends - sizes])
        x = np.zeros(len(values), np.int64)
        x[~bad] = np.floor(GRID * values[~bad]).astype(np.int64)
        kept = np.repeat(use, sizes)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[use])]).astype(np.int32)), pa.array(x[kept]))
        yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(use)), lists], names=["id", "x"])


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, x (array of long) of the rows that take part."""
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    read = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("vector")).where("vector IS NOT NULL")
    return read.mapInArrow(_integers, "id long, x array<long>")


def _matrix(column, d: int) -> np.ndarray:
    """A batch's vectors as rows."""
    if isinstance(column, pd.Series):
        return np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.empty((0, d), np.int64)
    return column.flatten().to_numpy().reshape(-1, d)


def _half_sums(d: int):
    """Sums by dimension of the upper and the lower half of each x: neither can pass a long within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, upper, lower = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            n, upper, lower = n + len(x), upper + (x >> _HALF).sum(0), lower + (x & ((1 << _HALF) - 1)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(upper), pa.array(lower)], names=["dim", "n", "upper", "lower"])

    return run


def totals(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """n and S of the fit list: a row for each task and dimension is shuffled."""
    whole = "decimal(38,0)"
    rows = fit.mapInArrow(_half_sums(d), "dim long, n long, upper long, lower long").groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("upper").cast(whole)).alias("upper"), F.sum(F.col("lower").cast(whole)).alias("lower")).collect()
    sums = {r["dim"]: (int(r["upper"]) << _HALF) + int(r["lower"]) for r in rows}
    return (int(rows[0]["n"]) if rows else 0), [sums.get(k, 0) for k in range(d)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: as longs where these suffice, else as Python's integers."""
    far = max([abs(int(x.max())), abs(int(x.min()))]) if x.size else 0
    if n * far + max(map(abs, sums)) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def rounded(gaps: np.ndarray, n: int) -> np.ndarray:
    """Exact gaps divided by n: both sides are doubles exactly where they are below 2**53, so there is one rounding."""
    if gaps.dtype == object or (gaps.size and max(abs(int(gaps.max())), abs(int(gaps.min()))) >= 1 << 53):
        return (gaps.astype(object) / n).astype(np.float64)
    return gaps / float(n)


def squares(gaps: np.ndarray) -> list[int]:
    """Exact sums of squares by row, by halves of 24 bits where gaps are below 2**48."""
    if gaps.dtype == object or (gaps.size and max(abs(int(gaps.max())), abs(int(gaps.min()))) >= 1 << 48) or gaps.shape[1] >= 1 << 14:
        return [sum(v * v for v in map(int, row)) for row in gaps]
    a, b = gaps >> 24, gaps & ((1 << 24) - 1)
    return [(p << 48) + (q << 25) + r for p, q, r in zip((a * a).sum(1).tolist(), (a * b).sum(1).tolist(), (b * b).sum(1).tolist(), strict=True)]


def _centred_rows(d: int, n: int, sums: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                gaps = rounded(centred(_matrix(batch.column("x"), d), n, sums), n)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, gaps.size + 1, d).astype(np.int32)), pa.array(gaps.ravel()))], names=["gap"])

    return run


def covariance(fit: DataFrame, d: int, n: int, sums: list[int]) -> np.ndarray:
    """V of the fit list: the Gramian of its centred rows, divided by n."""
    rows = fit.mapInArrow(_centred_rows(d, n, sums), "gap array<double>").select(array_to_vector("gap").alias("gap"))
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "gap"), n, d).computeGramianMatrix().toArray() / n


def components(v: np.ndarray, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Axes (a row each, largest entry positive), eigenvalues (0 where rounding could be all there is) and shares of the trace."""
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:count], axes.T[::-1][:count]
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    trace = float(np.trace(v))
    values = np.where(values > len(v) * np.finfo(float).eps * max(values[0], 0.0), values, 0.0)
    return axes, values, values / trace if trace > 0 else np.full(len(values), np.nan)


def _whiten(shared, d: int):
    """Whitened rows: one for each row and component."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, axes, values, shares = shared.value
        k = len(axes)
        with np.errstate(divide="ignore"):
            scale = np.where(values > 0, 1 / np.sqrt(values), np.nan)
        for frame in frames:
            if not len(frame):
                continue
            gaps = centred(_matrix(frame["x"], d), n, sums)
            white = rounded(gaps, n) @ axes.T * scale
            yield pd.DataFrame({
                "id": np.repeat(frame["id"].astype("Int64").to_numpy(dtype=object, na_value=None), k), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(frame)), "n": n,
                "deviation": np.repeat(np.array([str(s) for s in squares(gaps)], object), k), "whitened": white.ravel(), "explained": np.tile(shares, len(frame)),
            })

    return run


def identity_error(white: DataFrame, axes: list[int]) -> float | None:
    """Largest absolute entry of the covariance of whitened columns w1, w2, ... minus the identity; centred before multiplying."""
    if not axes:
        return None
    n, *means = white.agg(F.count("*"), *[F.avg(f"w{k}") for k in axes]).first()
    gap = {k: F.col(f"w{k}") - F.lit(m) for k, m in zip(axes, means, strict=True)}
    pairs = [(i, j) for i in axes for j in axes if i <= j]
    sums = white.agg(*[F.sum(gap[i] * gap[j]) for i, j in pairs]).first()
    return max(abs(s / n - (i == j)) for (i, j), s in zip(pairs, sums, strict=True))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """id, component, n, deviation decimal(38,0), whitened, explained, identity_error: of each usable row and each of the first components."""
    spark, whole = vectors.sparkSession, integers(vectors, id_col, vector_col)
    schema = "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    lists = staged(whole.select("x").distinct(), "fit")
    lengths = lists.groupBy(F.size("x").alias("d"))
    # Most rows, not most distinct vectors, settle the length; where one length is all there is, that needs no pass over the rows.
    d = [r["d"] for r in lengths.agg(F.count("*").alias("n")).orderBy("d").limit(2).collect()]
    if not d:
        return spark.createDataFrame([], schema)
    d = d[0] if len(d) == 1 else whole.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()["d"]
    fit = lists.where(F.size("x") == d)
    n, sums = totals(fit, d)
    axes, values, shares = components(covariance(fit, d, n, sums), count)
    # Dimension times count numbers: bounded by the length of one vector.
    shared = spark.sparkContext.broadcast((n, sums, axes, values, shares))
    run, sized = _whiten(shared, d), lambda rows: rows.where(F.size("x") == d)
    firm = [k + 1 for k in range(len(axes)) if values[k] > 0]
    wide = fit.select(F.lit(None).cast("long").alias("id"), "x").mapInPandas(_wide(run, len(axes)), ", ".join(f"w{k + 1} double" for k in range(len(axes))))
    error = identity_error(staged(wide, "whitened"), firm)
    null_nan = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    found = sized(whole).mapInPandas(run, _OUT)
    return found.select("id", "component", "n", F.col("deviation").try_cast("decimal(38,0)").alias("deviation"), null_nan("whitened"), null_nan("explained"), F.lit(error).cast("double").alias("identity_error"))


def _wide(run, k: int):
    """The same whitened numbers, a row for each vector."""

    def wide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in run(frames):
            yield pd.DataFrame(frame["whitened"].to_numpy().reshape(-1, k), columns=[f"w{i + 1}" for i in range(k)])

    return wide


def query(spark, sf_dir: str) -> DataFrame:
    """op11: the first four components of every embedding; a deviation that is no long is null here, the operator has it whole."""
    found = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return found.select(F.col("id").alias("vec_id"), "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")
