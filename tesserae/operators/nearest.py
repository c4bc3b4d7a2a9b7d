"""Exact nearest neighbours by blocks: a matrix product of query and entry blocks finds candidates, these are scored anew one by one.

Rows of one length are packed into blocks of vectors; every query block meets every entry block of its length (that is what an exact search is), and
of each meeting only the first k of each query leave the task, with all that ties with the last of them within the rounding of scores. The product's
rounding error is far below that margin, so no neighbour is lost; the scores returned are sums over the vectors as they are. Of equal scores of a
query only the first k ids leave a meeting, so that copies don't flood what follows. What a task holds goes by the sizes of blocks, not of tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRY_BLOCK, QUERY_BLOCK = 4096, 512
#: Queries of a block that are scored at once: scores of so many by a block of entries are held, not of all.
QUERY_SLICE = 64
#: What the product's error can't reach, for unit vectors; scaled by norms for the others.
SLACK = 1e-9
METRICS = ("cosine", "dot", "euclid")


def _blocks(size: int, name: str):
    """(dim, ids, vectors, n) of rows (id, vector); vectors that are null, empty or hold a null or a number that isn't finite take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[pa.Array, np.ndarray]]] = {}

        def out(dim: int) -> pa.RecordBatch:
            parts = held.pop(dim)
            ids, vectors = pa.concat_arrays([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), listed, pa.array([vectors.tobytes()], pa.binary())], names=[f"{name}dim", f"{name}ids", f"{name}vectors"])

        for batch in batches:
            column = batch.column("vector")
            lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            whole = column.flatten().cast(pa.float64())
            values = whole.fill_null(np.nan).to_numpy(zero_copy_only=False)
            holes = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            ends = np.cumsum(lengths)
            starts = ends - lengths
            usable = (lengths > 0) & (holes[ends] == holes[starts])
            for dim in np.unique(lengths[usable]).tolist():
                rows = np.flatnonzero(usable & (lengths == dim))
                for a in range(0, len(rows), size):
                    cut = rows[a : a + size]
                    held.setdefault(dim, []).append((batch.column("id").take(pa.array(cut)), values[starts[cut][:, None] + np.arange(dim)]))
                    if sum(len(p[1]) for p in held[dim]) >= size:
                        yield out(dim)
        for dim in list(held):
            yield out(dim)

    return run


def packed(rows: DataFrame, id_col: str, vector_col: str, size: int, name: str) -> DataFrame:
    kind = dict(rows.dtypes)[id_col]
    return rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).mapInArrow(_blocks(size, name), f"{name}dim int, {name}ids array<{kind}>, {name}vectors binary")


def approximate(q: np.ndarray, e: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Scores by one product, and how far each query's may be off."""
    qn, en = np.sqrt((q * q).sum(1)), np.sqrt((e * e).sum(1))
    if metric == "cosine":
        unit = lambda v, n: v / np.where(n > 0, n, 1)[:, None]
        return unit(q, qn) @ unit(e, en).T, np.full(len(q), SLACK)
    product = q @ e.T
    if metric == "dot":
        return product, SLACK * (1 + qn * en.max())
    near = product  # worked on in place
    near *= -2
    near += (qn**2)[:, None]
    near += en**2
    np.sqrt(np.maximum(near, 0, out=near), out=near)
    near += 1
    # A square root near 0 is off by the root of the product's error.
    return np.reciprocal(near, out=near), 1e-6 * (1 + qn + en.max())


def exact(q: np.ndarray, e: np.ndarray, metric: str) -> np.ndarray:
    """Scores of pairs, row by row."""
    if metric == "euclid":
        return 1 / (1 + np.sqrt(((q - e) ** 2).sum(1)))
    dots = (q * e).sum(1)
    if metric == "dot":
        return dots
    norms = np.sqrt((q * q).sum(1)) * np.sqrt((e * e).sum(1))
    return np.where(norms > 0, dots / np.where(norms > 0, norms, 1), 0.0)


def _first_ids(k: int, query: np.ndarray, score: np.ndarray, ids: pa.Array) -> np.ndarray:
    """Places of the first k ids of each query and score: what is beyond them is never among a query's first k."""
    order = np.lexsort((pc.rank(ids, tiebreaker="first").to_numpy(), score, query))
    new = np.r_[True, (query[order][1:] != query[order][:-1]) | (score[order][1:] != score[order][:-1])]
    at = np.arange(len(order))
    return np.sort(order[at - np.maximum.accumulate(np.where(new, at, 0)) < k])


def _first(metric: str, k: int, threshold: float | None, margin: float):
    def met(q: np.ndarray, e: np.ndarray, entry_ids: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Places of queries, ids of entries and scores of what may be among the first k."""
        near, off = approximate(q, e, metric)
        least = np.full(len(q), -np.inf) if len(e) <= k else np.partition(near, len(e) - k, 1)[:, len(e) - k]
        least = least - margin - 2 * off
        if threshold is not None:
            least = np.maximum(least, threshold - off)
        rows, cols = np.nonzero(near >= least[:, None])
        score = np.concatenate([exact(q[rows[a : a + ENTRY_BLOCK]], e[cols[a : a + ENTRY_BLOCK]], metric) for a in range(0, len(rows), ENTRY_BLOCK)] or [np.empty(0)])
        if threshold is not None:
            kept = score >= threshold
            rows, cols, score = rows[kept], cols[kept], score[kept]
        ids = entry_ids.take(pa.array(cols))
        if len(rows) > k * len(q):
            kept = _first_ids(k, rows, score, ids)
            rows, ids, score = rows[kept], ids.take(pa.array(kept)), score[kept]
        return rows, ids, score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column("dim")[i].as_py()
                q, e = (np.frombuffer(batch.column(c)[i].as_buffer(), np.float64).reshape(-1, dim) for c in ("qvectors", "vectors"))
                for a in range(0, len(q), QUERY_SLICE):
                    rows, ids, score = met(q[a : a + QUERY_SLICE], e, batch.column("ids")[i].values)
                    if len(rows):
                        yield pa.RecordBatch.from_arrays([batch.column("qids")[i].values.take(pa.array(rows + a)), ids, pa.array(score)], names=["query_id", "entry_id", "score"])

    return run


def candidates(entries: DataFrame, queries: DataFrame, metric: str, k: int, threshold: float | None = None, digits: int = 6, small: bool = True) -> DataFrame:
    """query_id, entry_id, score (unrounded): the k best entries of each query are among them, a few of each meeting of blocks.

    entries: entry_id, vector; queries: query_id, q_vector. small: whether the queries are of a size that may be broadcast, as the caller has
    checked; else both sides' blocks are dealt by length and slice, each query block going to every slice.
    """
    own = packed(entries, "entry_id", "vector", ENTRY_BLOCK, "")
    asked = packed(queries, "query_id", "q_vector", QUERY_BLOCK, "q")
    if small:
        met = own.join(F.broadcast(asked), own["dim"] == asked["qdim"])
    else:
        slices = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        own = own.withColumn("slice", F.pmod(F.xxhash64("vectors"), F.lit(slices)).cast("int"))
        asked = asked.withColumn("qslice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        met = own.join(asked, (own["dim"] == asked["qdim"]) & (own["slice"] == asked["qslice"]))
    kinds = dict(queries.dtypes)["query_id"], dict(entries.dtypes)["entry_id"]
    return met.select("dim", "ids", "vectors", "qids", "qvectors").mapInArrow(_first(metric, k, threshold, 10.0**-digits), f"query_id {kinds[0]}, entry_id {kinds[1]}, score double")
