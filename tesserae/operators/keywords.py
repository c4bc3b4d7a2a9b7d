"""Best keyword hits by counts: in each task, the terms of many entries meet all queries by one table, and only the first k of each query leave it.

A score is .85 a / n + .15 b / n for a of the query's n terms in the content and b in the title; it goes by 17 a + 3 b,
a whole number, so that ties are exact. Entries tie by id, in Spark's order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counts of entries and queries that are held at once.
CELLS = 4_000_000


def counts(terms: pa.ListArray, vocabulary: pa.Array, asks: np.ndarray) -> np.ndarray:
    """How many of each query's terms each entry has. asks: whether (1 or 0) a query (column) asks for a term (row)."""
    out = np.zeros((len(terms), asks.shape[1]), np.int32)
    place = pc.index_in(terms.flatten(), value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(terms)), terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))[place >= 0]
    place = place[place >= 0]
    step = max(1, CELLS // asks.shape[1])
    for i in range(0, len(place), step):
        own = owner[i : i + step]
        start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out[own[start]] += np.add.reduceat(asks[place[i : i + step]], start, 0, np.int32)
    return out


def _first(k: int, query: np.ndarray, key: np.ndarray, ids: pa.Array) -> np.ndarray:
    """Places of the first k of each query by (key descending, id)."""
    order = np.lexsort((pc.rank(ids, tiebreaker="dense").to_numpy(), -key, query))
    of = query[order]
    return order[np.arange(len(of)) - np.searchsorted(of, of) < k]


def _best(k: int, vocabulary: pa.Array, asks: np.ndarray, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = asks.shape[1]
        step = max(1, CELLS // n)
        query, a, b, ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), pa.array([], kind)
        least = np.ones(n, np.int64)  # what a query's next hit must reach
        take = 4 * k  # few at first, until there is something to reach
        for batch in batches:
            i = 0
            while i < batch.num_rows:
                part = batch.slice(i, take)
                i, take = i + take, min(2 * take, step)
                content, title = (counts(part.column(c), vocabulary, asks) for c in ("content", "title"))
                rows, cols = np.nonzero(17 * content + 3 * title >= least)
                if not len(rows):
                    continue
                query, a, b = np.r_[query, cols], np.r_[a, content[rows, cols]], np.r_[b, title[rows, cols]]
                ids = pa.concat_arrays([ids, part.column("entry_id").take(pa.array(rows))])
                kept = _first(k, query, 17 * a + 3 * b, ids)
                query, a, b, ids = query[kept], a[kept], b[kept], ids.take(pa.array(kept))
                full = np.bincount(query, minlength=n) >= k
                last = np.full(n, np.iinfo(np.int64).max)
                np.minimum.at(last, query, 17 * a + 3 * b)
                least = np.where(full, last, 1)
        yield pa.RecordBatch.from_arrays([pa.array(query), ids, pa.array(a), pa.array(b)], names=["place", "entry_id", "a", "b"])

    return run


def best(entries: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, entry_id, n_terms, a, b: the first k entries of each query are among them.

    entries: entry_id (none null, none twice), content and title, as arrays of distinct terms; asked: query_id, terms, of a
    size that may be broadcast, as the caller has checked: tasks get them as one table.
    """
    rows = asked.where(F.size("terms") > 0).select("terms", F.struct("query_id").alias("q")).toPandas()
    kind, of = dict(entries.dtypes)["entry_id"], dict(asked.dtypes)["query_id"]
    schema = f"query_id {of}, n_terms int, place long"
    words = sorted({t for terms in rows["terms"] for t in terms})
    at = {t: i for i, t in enumerate(words)}
    asks = np.zeros((len(words), max(1, len(rows))), np.int8)
    for j, terms in enumerate(rows["terms"]):
        asks[[at[t] for t in terms], j] = 1
    named = entries.sparkSession.createDataFrame([(q["query_id"], len(terms), j) for j, (q, terms) in enumerate(zip(rows["q"], rows["terms"], strict=True))], schema)
    arrow = pa.string() if kind == "string" else pa.from_numpy_dtype(np.dtype({"bigint": np.int64, "int": np.int32}[kind]))
    found = entries.select("entry_id", "content", "title").mapInArrow(_best(k, pa.array(words, pa.string()), asks, arrow), f"place long, entry_id {kind}, a long, b long")
    return found.join(F.broadcast(named), "place").select("query_id", "entry_id", "n_terms", "a", "b")
