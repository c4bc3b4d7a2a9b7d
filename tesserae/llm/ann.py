"""Approximate nearest neighbours by additive quantisation.

``BOOKS`` full-dimensional codebooks of ``WORDS`` vectors each are trained one after another on the residuals of a
sample of at most ``SAMPLE`` vectors (those with the smallest hashes of their ids), then refitted together by least
squares. Every vector is encoded by beam search over the books and stored as its codes and the squared norm of their
sum, in blocks of ``BLOCK``. A query scores all codes by lookup tables, |x|^2 - 2 sum of <q, word>; the ``SHORT`` best of
the whole table by these scores (ties: smaller ids) are its shortlist. Only their vectors are fetched, by row, and ranked
by exact distances in double precision.

Queries meet the index block by block: index blocks are dealt to ``PARTS`` parts and query blocks to groups of about
``HELD``; a cell of a group and a part keeps the shortlists of its query blocks and gives each once, and parts' lists are
merged one after another, so that what is held is bounded and what is passed on goes by queries and parts, not by pairs.
The work is codes times queries; a shortlist of fixed length is a smaller share of a larger table, so recall falls slowly
as tables grow (figures: README).

Defined cases: vectors that are null, zero, of another length than most of the sample, or that hold null or
non-finite components take no part, nor do rows without an id; each row is a candidate of its own, also where it repeats
an id or a vector; a query leaves out one row, the first with its id and vector; of repeated query ids the first
vector, by components, asks; an empty table or query set gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm._shared import staged

BOOKS, WORDS, SAMPLE, ROUNDS, BEAM = 32, 64, 12_288, 4, 4
BLOCK, QUERIES, SHORT, TOP = 2048, 256, 512, 10
#: Parts of the index, and query blocks of a group, about: a task holds the shortlists of one.
PARTS, HELD = 16, 8
#: Scores are compared in steps of this share of the mean norm, so that equal codes tie wherever they are scored.
STEP = 1e-6


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector of the rows that take part, but for their length."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), v.alias("vector"))


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    half = 0.5 * np.einsum("ij,ij->i", words, words)
    return np.concatenate([(half - x[i : i + 4096] @ words.T).argmin(1) for i in range(0, len(x), 4096)])


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 0) -> np.ndarray:
    """Codebooks (books, words, dimension) of float32."""
    draw, n = np.random.default_rng(seed), len(x)
    x = x.astype(np.float32)
    rest, out, codes = x.copy(), [], []
    for _ in range(books):
        book = rest[draw.choice(n, words, replace=n < words)] + draw.normal(0, 1e-4, (words, x.shape[1])).astype(np.float32)
        for _ in range(ROUNDS):
            code = _nearest(rest, book)
            count = np.bincount(code, minlength=words)
            order = np.argsort(code, kind="stable")
            filled = np.flatnonzero(count)
            book[filled] = np.add.reduceat(rest[order], np.r_[0, np.cumsum(count)[:-1]][filled]) / count[filled, None]
        code = _nearest(rest, book)
        rest -= book[code]
        out.append(book)
        codes.append(code)
    books_ = np.stack(out)
    return _refit(x, encode(x, books_)[0], books, words)


def _refit(x: np.ndarray, codes: np.ndarray, books: int, words: int) -> np.ndarray:
    """The codebooks whose sums come closest to x under these codes, by ridge regression."""
    total = books * words
    column = codes + np.arange(books) * words
    gram, right = np.eye(total) * 0.1, np.zeros((total, x.shape[1]))
    for i in range(0, len(x), 1024):
        used = np.zeros((len(column[i : i + 1024]), total), np.float32)
        used[np.arange(len(used))[:, None], column[i : i + 1024]] = 1
        gram += used.T @ used
        right += used.T @ x[i : i + 1024]
    return np.linalg.solve(gram, right).reshape(books, words, -1).astype(np.float32)


def encode(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, books) by beam search, and the squared norms of what they stand for."""
    m, words, d = books.shape
    square = np.einsum("mwd,mwd->mw", books, books)
    codes, norms = [np.empty((0, m), np.int64)], [np.empty(0, np.float32)]
    for i in range(0, len(x), 512):
        part = x[i : i + 512].astype(np.float32)
        n, row = len(part), np.arange(len(part))[:, None]
        rest, cost = part[:, None, :], np.zeros((n, 1), np.float32)
        chosen = np.zeros((n, 1, 0), np.int64)
        for b in range(m):  # |rest - word|^2 but for |part|^2, of every beam and word
            new = cost[:, :, None] + square[b] - 2 * (rest.reshape(-1, d) @ books[b].T).reshape(n, -1, words)
            new = new.reshape(n, -1)
            keep = min(BEAM, new.shape[1]) if b < m - 1 else 1
            best = np.argpartition(new, keep - 1, 1)[:, :keep]
            beam, word = best // words, best % words
            cost = new[row, best]
            rest = rest[row, beam] - books[b][word]
            chosen = np.concatenate([chosen[row, beam], word[:, :, None]], 2)
        codes.append(chosen[:, 0])
        said = part - rest[:, 0]
        norms.append(np.einsum("ij,ij->i", said, said))
    return np.concatenate(codes), np.concatenate(norms)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, d)


def _binary(*names: str) -> pa.Schema:
    return pa.schema([(n, pa.binary()) for n in names])


def index(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """Blocks of encoded vectors: ids, row numbers, codes, norms. rows: id, row, vector, all of the books' dimension."""
    d = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                codes, norms = encode(_matrix(part.column("vector"), d), books)
                out = {"ids": part.column("id").to_numpy().tobytes(), "places": part.column("row").to_numpy().tobytes(), "codes": codes.astype(np.uint8).tobytes(), "norms": norms.astype(np.float32).tobytes()}
                yield pa.RecordBatch.from_pylist([out], _binary(*out))

    return rows.mapInArrow(run, "ids binary, places binary, codes binary, norms binary")


def _query_blocks(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, QUERIES):
                part = batch.slice(i, QUERIES)
                out = {"q_ids": part.column("id").to_numpy().tobytes(), "q_own": part.column("own").to_numpy().tobytes(), "q_vectors": _matrix(part.column("vector"), d).tobytes()}
                yield pa.RecordBatch.from_pylist([out], _binary(*out))

    return run


def scores(q: np.ndarray, codes: np.ndarray, norms: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Squared distances of the coded vectors to each query, but for the query's own norm, by lookup tables."""
    m, words, d = books.shape
    table = (q.astype(np.float32) @ books.reshape(-1, d).T).reshape(len(q), m, words)
    out = np.repeat(norms[None], len(q), 0)
    for b in range(m):
        out -= 2 * table[:, b, codes[:, b]]
    return out


#: Shortlists of a query block, one after another: how long each is, then keys (scores in steps), ids and row numbers.
Lists = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def shorter(lists: list[Lists], short: int) -> Lists:
    """The first ``short`` by (key, id, row number) of the shortlists of one query block."""
    n = len(lists[0][0])
    owner = np.concatenate([np.repeat(np.arange(n), x[0]) for x in lists])
    key, ids, place = (np.concatenate([x[k] for x in lists]) for k in (1, 2, 3))
    order = np.lexsort((place, ids, key, owner))
    owner = owner[order]
    order = order[np.arange(len(owner)) - np.searchsorted(owner, owner) < short]
    return np.bincount(np.concatenate([np.repeat(np.arange(n), x[0]) for x in lists])[order], minlength=n), key[order], ids[order], place[order]


def best_of_block(q: np.ndarray, own: np.ndarray, ids: np.ndarray, place: np.ndarray, codes: np.ndarray, norms: np.ndarray, books: np.ndarray, step: float, short: int) -> Lists:
    """Shortlists of a query block in an index block."""
    key = np.rint(scores(q, codes, norms, books) / step).astype(np.int64)
    at = np.repeat(np.arange(len(ids))[None], len(q), 0)
    if len(ids) > short:  # what may belong to the first: all up to the key of the last of them
        some = key <= np.partition(key, short, 1)[:, short : short + 1]
    else:
        some = np.ones(key.shape, bool)
    some &= place[None] != own[:, None]
    return shorter([(some.sum(1), key[some], ids[at[some]], place[at[some]])], short)


_LISTS = "q_ids binary, n binary, keys binary, ids binary, places binary"


def _packed(q_ids: bytes, lists: Lists) -> dict:
    return {"q_ids": q_ids, **{k: v.astype(np.int64).tobytes() for k, v in zip(("n", "keys", "ids", "places"), lists, strict=True)}}


def _unpacked(row: dict) -> Lists:
    return tuple(np.frombuffer(row[k], np.int64) for k in ("n", "keys", "ids", "places"))


def _shortlists(books: np.ndarray, dtype: np.dtype, step: float, short: int):
    """Shortlists of the query blocks of each cell (g, part), of whose rows the query blocks (kind 0) come before the index blocks.

    A task holds the shortlists of one cell, and gives each once.
    """
    m, _, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, held = None, {}, {}

        def out() -> Iterator[pa.RecordBatch]:
            for q_ids, lists in held.items():
                yield pa.RecordBatch.from_pylist([_packed(q_ids, lists)], _binary("q_ids", "n", "keys", "ids", "places"))

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if (row["g"], row["part"]) != cell:
                    yield from out()
                    cell, asked, held = (row["g"], row["part"]), {}, {}
                ids, places = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["places"], np.int64)
                if row["kind"] == 0:
                    asked[row["ids"]] = (np.frombuffer(row["vectors"], dtype).reshape(-1, d), places)
                    continue
                codes, norms = np.frombuffer(row["codes"], np.uint8).reshape(-1, m), np.frombuffer(row["norms"], np.float32)
                for q_ids, (q, own) in asked.items():
                    new = best_of_block(q, own, ids, places, codes, norms, books, step, short)
                    held[q_ids] = new if q_ids not in held else shorter([held[q_ids], new], short)
        yield from out()

    return run


def _pairs(short: int):
    """Query ids and row numbers of the whole table's shortlists, from the lists of its parts, which come in order of their query blocks."""

    def out(q_ids: bytes, lists: Lists) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.frombuffer(q_ids, np.int64), lists[0])), pa.array(lists[3])], names=["query_id", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                lists = _unpacked(row)
                if row["q_ids"] == now:
                    held = shorter([held, lists], short)
                    continue
                if held is not None:
                    yield out(now, held)
                now, held = row["q_ids"], lists
        if held is not None:
            yield out(now, held)

    return run


def _distances(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gap = _matrix(batch.column("vector"), d).astype(np.float64) - _matrix(batch.column("asked"), d).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(np.sqrt((gap * gap).sum(1)))], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, short: int = SHORT) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (distance): the nearest rows of each query but its own row."""
    spark = vectors.sparkSession
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    sample = rows.orderBy(F.xxhash64("id"), "id", "vector").limit(SAMPLE).toPandas()["vector"]  # a bounded sample
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = sample.map(len)
    d = int(lengths.mode()[0])
    dtype = np.dtype(np.float32 if dict(vectors.dtypes)[vector_col] == "array<float>" else np.float64)
    fitted = np.stack(sample[lengths == d])
    books, step = train(fitted), STEP * float(np.square(fitted.astype(np.float64)).sum(1).mean())
    element = "float" if dtype == np.float32 else "double"
    sized = lambda f: f.where(F.size("vector") == d).withColumn("vector", F.col("vector").cast(f"array<{element}>"))
    rows = staged(sized(rows).withColumn("row", F.monotonically_increasing_id()), "vectors")
    first = sized(asked).groupBy("id").agg(F.min("vector").alias("vector"))
    same = rows.select("id", F.col("vector").alias("own_vector"), "row")
    asked = staged(first.join(same, "id", "left").groupBy("id", "vector").agg(F.coalesce(F.min(F.when(F.col("own_vector") == F.col("vector"), F.col("row"))), F.lit(-1)).alias("own")), "queries")
    n = asked.count()
    groups = max(1, -(-n // (QUERIES * HELD)))
    dealt = asked.repartition(groups, "id") if groups > 1 else asked.coalesce(1)
    packed = staged(dealt.mapInArrow(_query_blocks(d), "q_ids binary, q_own binary, q_vectors binary").withColumn("g", F.pmod(F.spark_partition_id(), F.lit(groups))), "asked")
    none = F.lit(None).cast("binary")
    packed = packed.select("g", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), F.lit(0).alias("kind"), F.col("q_ids").alias("ids"), F.col("q_own").alias("places"), none.alias("codes"), none.alias("norms"), F.col("q_vectors").alias("vectors"))
    part = F.pmod(F.xxhash64("ids", "places"), F.lit(PARTS)).cast("int")
    blocks = staged(index(rows, books), "codes").select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), part.alias("part"), F.lit(1).alias("kind"), "ids", "places", "codes", "norms", none.alias("vectors"))
    # A stated query set against all rows, block by block; codes only. Blocks meet in the task: as joined rows each would be copied for every other.
    met = packed.unionByName(blocks).repartition("g", "part").sortWithinPartitions("g", "part", "kind")
    lists = met.mapInArrow(_shortlists(books, dtype, step, short), _LISTS).repartition("q_ids").sortWithinPartitions("q_ids")
    pairs = lists.mapInArrow(_pairs(short), "query_id long, row long")
    fetched = pairs.join(rows.select("row", F.col("id").alias("vec_id"), "vector"), "row").join(asked.select(F.col("id").alias("query_id"), F.col("vector").alias("asked")), "query_id")
    found = fetched.select("query_id", "vec_id", "vector", "asked").mapInArrow(_distances(d), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the 10 nearest of every row whose id is divisible by 100."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 100 = 0"))
