"""LM scoring: a hashed maximum-entropy model with a class-factored softmax, trained by distributed gradient updates.

Tokens are the words of a text and one end. The first ``HEAD`` words by count are outcomes of their own, in classes of
``WIDE`` by rank; all others are one outcome more, a class by itself:

    P(token | history) = P(class | history) * P(word | class, history)      for the first words
    P(token | history) = P(rest | history) * (c + 1) / (N' + V' + 1)        for all others, N' and V' counted over these

Both factors are softmaxes over hashed features: the token before, the two before as one (n-grams), and the tokens two and three
back by themselves (skips); in the second factor each together with the class. Each factor has a table of 2**16 rows of
``WIDE`` weights.

1. Every training token is counted, in Spark. The commonest words, ``KNOWN`` at most, are broadcast (3 MB), the rest stays a table.
2. One pass over all training tokens in ``ROUNDS`` rounds, each over the documents of one hash slice. The workers of a round
   start from the broadcast weights (16 MB, fixed), take Adagrad steps on minibatches of their own rows, and send their weights
   in blocks; a row's new weights are the mean over the workers, by how often each one met the feature (parameter mixing).
3. Each text is scored in sparse batches. Words beyond the broadcast ones meet their counts in a join, once per text and word;
   they are rarer than ``KNOWN`` others, so no key is hot.

Defined cases: a null text counts as empty and has one token, its end; a null id belongs to the training part; repeated
rows each count and are each scored; very long texts are worked on in parts of ``BATCH`` tokens. Without training rows all counts are 0
and both scores are those of equal chances. An empty table gives no rows. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm._shared import staged, texts
from tesserae.llm._text import Words, cuts, lists, mix, pieces, signed

#: Weights of a row, first words (31 classes of 32), words whose counts are broadcast, rows of a table.
WIDE, KNOWN, ROWS = 32, 1 << 17, 1 << 16
CLASSES = WIDE - 1
HEAD, REST = CLASSES * WIDE, CLASSES
#: Rounds of the one pass, tokens that a worker of a round should have at least, tokens of a minibatch, rows of a block that is sent.
ROUNDS, WORKER_TOKENS, BATCH, BLOCK_ROWS = 4, 1 << 21, 1 << 13, 1 << 12
RATE, START, LIMIT = 0.6, 0.05, 8.0
#: Held out are the rows whose crc32 leaves this rest.
FOLDS, HELD_OUT = 7, 2
_END = np.uint64(0xE7037ED1A0B428DB)
_EDGE = np.uint64(0x8EBC6AF09C88C6E3)
_AT_ONCE = 1 << 21
_SHIFT = np.uint64(44)
_FEATURES = (4, 3)
_ONES = np.ones(WIDE, np.float32)


def held_out(id_col: str | Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 7, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of some texts, each with its end, and the offsets of the texts in them."""
    w = Words(column, fold=True)
    offs = w.first + np.arange(w.n_docs + 1)
    out = np.full(offs[-1], _END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[offs[1:] - 1] = False
    out[inside] = w.hashes
    return out, offs


class Known(NamedTuple):
    """Counts of the commonest words, found by the upper 20 bits of their hash; rank: by count, from 0."""

    ids: np.ndarray
    counts: np.ndarray
    ranks: np.ndarray
    starts: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, counts: np.ndarray) -> Known:
        """From words in order of rank."""
        order = np.argsort(ids)
        return Known(ids[order], counts[order], order, np.searchsorted(ids[order] >> _SHIFT, np.arange((1 << 20) + 1, dtype=np.uint64)).astype(np.int32))

    def find(self, ids: np.ndarray) -> np.ndarray:
        """The place of each word here, or -1."""
        out = np.full(len(ids), -1, np.int64)
        if not len(self.ids):
            return out
        bucket = (ids >> _SHIFT).astype(np.int64)
        at, stop = self.starts[bucket].astype(np.int64), self.starts[bucket + 1]
        left = np.flatnonzero(at < stop)
        while len(left):
            hit = self.ids[at[left]] == ids[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < stop[left]]
        return out


class Model(NamedTuple):
    """Bias of classes and of words in their class, and the two tables of weights."""

    class_bias: np.ndarray
    word_bias: np.ndarray
    class_rows: np.ndarray
    word_rows: np.ndarray

    @staticmethod
    def start(head: np.ndarray, rest: float) -> Model:
        """From the counts of the first words and the weight of all others; words that there aren't get no chance."""
        n = np.zeros(HEAD)
        n[: len(head)] = head
        n = n.reshape(CLASSES, WIDE)
        with np.errstate(divide="ignore"):
            words, classes = np.log(n / np.maximum(n.sum(1, keepdims=True), 1)), np.log(np.append(n.sum(1), rest) / (n.sum() + rest))
        clip = lambda x: np.maximum(x, -1e4).astype(np.float32)
        return Model(clip(classes), clip(words), np.zeros((ROWS, WIDE), np.float32), np.zeros((ROWS, WIDE), np.float32))


def _hashed(*parts: np.ndarray | int) -> np.ndarray:
    key = np.uint64(0)
    for x in parts:
        key = mix(np.atleast_1d(key * np.uint64(0xD1342543DE82EF95) + (np.uint64(x) if isinstance(x, int) else x)))
    return (key >> np.uint64(48)).astype(np.uint16)


class Histories:
    """Feature rows of the tokens of some texts."""

    def __init__(self, ids: np.ndarray, offs: np.ndarray):
        back = np.full((3, len(ids)), _EDGE, np.uint64)
        place = np.arange(len(ids)) - np.repeat(offs[:-1], np.diff(offs))
        for k in range(3):
            back[k, k + 1 :] = ids[: max(0, len(ids) - k - 1)]
            back[k, place <= k] = _EDGE
        self.one, self.two, self.three = back
        self.pair = mix(self.one * np.uint64(3) + self.two)

    def of_class(self, a: int, b: int) -> np.ndarray:
        return np.stack([_hashed(1, self.one[a:b]), _hashed(2, self.two[a:b]), _hashed(3, self.pair[a:b]), _hashed(4, self.three[a:b])])

    def of_word(self, at: np.ndarray, classes: np.ndarray) -> np.ndarray:
        c = classes.astype(np.uint64) + np.uint64(8)
        return np.stack([_hashed(c, self.one[at]), _hashed(c + np.uint64(64), self.two[at]), _hashed(c + np.uint64(128), self.pair[at])])


def chances(rows: np.ndarray, features: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Softmax by row, as numerators and their sums; as weights are at most ``LIMIT``, these stay within floats."""
    z, one = np.empty((features.shape[1], WIDE), np.float32), np.empty((features.shape[1], WIDE), np.float32)
    np.take(rows, features[0], axis=0, out=z, mode="clip")
    for f in features[1:]:
        z += np.take(rows, f, axis=0, out=one, mode="clip")
    z += bias
    np.exp(z, out=z)
    return z, z @ _ONES


def _step(rows: np.ndarray, squares: np.ndarray, met: np.ndarray, features: np.ndarray, p: np.ndarray, total: np.ndarray, truth: np.ndarray) -> None:
    """One Adagrad step on a minibatch, in place; each row has one step size."""
    n = len(truth)
    p *= (1 / total)[:, None]
    p[np.arange(n), truth] -= 1
    flat = features.ravel()
    order = np.argsort(flat, kind="stable")
    sorted_ = flat[order]
    begins = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    gaps = np.take(p, order % n, axis=0, mode="clip")
    # Pairs of floats add up as one complex number: half the steps.
    sums, hit = np.add.reduceat(gaps.view(np.complex64), begins, axis=0).view(np.float32), sorted_[begins]
    squares[hit] += np.einsum("ij,ij->i", sums, sums)
    met[hit] += np.diff(np.append(begins, len(order)))
    sums *= (RATE / np.sqrt(squares[hit]))[:, None]
    rows[hit] = np.clip(rows[hit] - sums, -LIMIT, LIMIT)


def _train(shared):
    """A worker of a round: steps through its rows, then sends how often it met each row, what its squares grew by, and its weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model, squares = shared.value
        tables, squares, met = [x.copy() for x in model[2:]], [x.copy() for x in squares], [np.zeros(ROWS, np.float32) for _ in _FEATURES]
        began = [x.copy() for x in squares]
        for batch in pieces(batches):
            ids, offs = tokens(batch.column("text"))
            rank = known.find(ids)
            rank[rank >= 0] = known.ranks[rank[rank >= 0]]
            classes = np.where((rank >= 0) & (rank < HEAD), rank // WIDE, REST)
            history = Histories(ids, offs)
            for a in range(0, len(ids), BATCH):
                b = min(a + BATCH, len(ids))
                features = history.of_class(a, b)
                _step(tables[0], squares[0], met[0], features, *chances(tables[0], features, model.class_bias), classes[a:b])
                at = a + np.flatnonzero(classes[a:b] != REST)
                if len(at):
                    features = history.of_word(at, classes[at])
                    _step(tables[1], squares[1], met[1], features, *chances(tables[1], features, model.word_bias[classes[at]]), rank[at] % WIDE)
        for level in range(2):
            for a in range(0, ROWS, BLOCK_ROWS):
                cut = slice(a, a + BLOCK_ROWS)
                if met[level][cut].any():
                    yield _block(level, a, met[level][cut], squares[level][cut] - began[level][cut], tables[level][cut])

    return run


_BLOCK = "level int, a int, met binary, squares binary, weights binary"


def _block(level: int, a: int, met: np.ndarray, squares: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
    """Rows of a table from a on; weights, at most LIMIT, as half floats."""
    data = [pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in ((met, np.float32), (squares, np.float32), (weights, np.float16))]
    return pa.RecordBatch.from_arrays([pa.array([level], pa.int32()), pa.array([a], pa.int32()), *data], names=["level", "a", "met", "squares", "weights"])


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["met"], np.float32), np.frombuffer(row["squares"], np.float32), np.frombuffer(row["weights"], np.float16).astype(np.float32).reshape(-1, WIDE)


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block for each place: weights as means by how often their workers met the row. All places together are 27 MB here."""
    held: dict[tuple[int, int], list[np.ndarray]] = {}
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            met, squares, weights = _unpacked(row)
            new = [met, squares, weights * met[:, None]]
            old = held.get((row["level"], row["a"]))
            held[row["level"], row["a"]] = new if old is None else [x + y for x, y in zip(old, new, strict=True)]
    for (level, a), (met, squares, weights) in held.items():
        yield _block(level, a, met, squares, weights / np.maximum(met, 1)[:, None])


def _mixed(model: Model, squares: list[np.ndarray], blocks: list) -> tuple[Model, list[np.ndarray]]:
    """The weights after a round: means over the workers, by how often each met the row."""
    tables, squares = [x.copy() for x in model[2:]], [x.copy() for x in squares]
    for r in blocks:
        cut, (met, added, weights) = slice(r["a"], r["a"] + BLOCK_ROWS), _unpacked(r)
        hit = met > 0
        tables[r["level"]][cut][hit] = weights[hit]
        squares[r["level"]][cut] += added
    return Model(model.class_bias, model.word_bias, *tables), squares


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n) of a task's tokens, added up in parts of bounded size."""
    held, size = [], 0

    def out():
        ids, index = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        n = np.bincount(index, np.concatenate([x[1] for x in held]), len(ids)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed(ids)), pa.array(n)], names=["id", "n"])

    for batch in pieces(batches):
        held.append(np.unique(tokens(batch.column("text"))[0], return_counts=True))
        size += len(held[-1][0])
        if size > _AT_ONCE:
            yield out()
            held, size = [], 0
    if held:
        yield out()


class Totals(NamedTuple):
    """Training tokens and distinct ones: all, and of those that aren't first words."""

    n: int
    v: int
    rest_n: int
    rest_v: int


def _scores(shared):
    """Of each text: its sums over the words that are known here, and the others with how often they stand in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model, totals = shared.value
        rest_base = np.log10(totals.rest_n + totals.rest_v + 1)
        for batch in pieces(batches):
            ids, offs = tokens(batch.column("text"))
            place = known.find(ids)
            seen = place >= 0
            rank, count = np.full(len(ids), HEAD), np.zeros(len(ids))
            rank[seen], count[seen] = known.ranks[place[seen]], known.counts[place[seen]]
            classes = np.where(rank < HEAD, rank // WIDE, REST)
            history, log_p = Histories(ids, offs), np.empty(len(ids))
            for a in range(0, len(ids), BATCH):
                b = min(a + BATCH, len(ids))
                p, total = chances(model.class_rows, history.of_class(a, b), model.class_bias)
                found = np.log10(np.maximum(p[np.arange(b - a), classes[a:b]] / total, 1e-30))
                at = np.flatnonzero(classes[a:b] != REST)
                if len(at):
                    p, total = chances(model.word_rows, history.of_word(a + at, classes[a + at]), model.word_bias[classes[a + at]])
                    found[at] += np.log10(np.maximum(p[np.arange(len(at)), rank[a + at] % WIDE] / total, 1e-30))
                log_p[a:b] = found
            counted = np.log10(count + 1)
            rest = classes == REST
            log_p[rest] += counted[rest] - rest_base
            by_doc = lambda x: np.add.reduceat(x, offs[:-1]) if len(x) else np.empty(0, x.dtype)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(offs))[~seen]
            far = ids[~seen]
            order = np.lexsort((far, doc))
            doc, far = doc[order], far[order]
            begins = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (far[1:] != far[:-1]))) if len(far) else np.empty(0, np.int64)
            ends = cuts(np.bincount(doc[begins], minlength=batch.num_rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(offs)), pa.array(by_doc(seen.astype(np.int64))), pa.array(by_doc(counted)), pa.array(by_doc(log_p)), lists(signed(far[begins]), ends), lists(np.diff(np.append(begins, len(far))), ends)],
                names=["doc_id", "held_out", "n_tokens", "seen", "counted", "log_p", "far", "times"],
            )

    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, seen long, counted double, log_p double, far array<long>, times array<long>"


def _commonest(counts: DataFrame, most: int) -> pd.DataFrame:
    """The commonest words (id, n), first to last: as many whole classes of counts as hold at most ``most`` words.

    Classes are sixteenths of a power of two, some hundreds in all, so what comes to the driver is bounded whatever the number of tasks.
    """
    step = F.floor(F.log2("n") * 16)
    left, least = most, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r["step"]):
        if r["words"] > left:
            break
        left, least = left - r["words"], r["step"]
    found = counts.where(step >= least if least is not None else F.lit(False)).toPandas()
    return found.sort_values(["n", "id"], ascending=[False, True])


def fit(docs: DataFrame) -> tuple[Known, Model, Totals, DataFrame]:
    """Counts and weights from the rows (doc_id, text, held_out) that aren't held out; the last is the table of all counts (id, n)."""
    spark = docs.sparkSession
    train = docs.where("NOT held_out")
    counts = staged(train.select("text").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")), "counts")
    v, n = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    top = _commonest(counts, KNOWN)
    ids, common = top["id"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    known, head = Known.of(ids, common), common[:HEAD]
    totals = Totals(n, v, n - int(head.sum()), v - len(head))
    model, squares = Model.start(head, totals.rest_n + totals.rest_v + 1), [np.full(ROWS, START, np.float32) for _ in _FEATURES]
    workers = max(1, min(spark.sparkContext.defaultParallelism, n // (ROUNDS * WORKER_TOKENS)))
    for k in range(ROUNDS if n else 0):
        part = train.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(ROUNDS)) == k).select("text").coalesce(workers)
        shared = spark.sparkContext.broadcast((known, model, squares))
        sent = part.mapInArrow(_train(shared), _BLOCK)
        model, squares = _mixed(model, squares, sent.repartition("level", "a").mapInArrow(_averaged, _BLOCK).collect())
        shared.destroy()  # its files leave the driver's and the executors' disks before the next round's come
    return known, model, totals, counts


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    rows = texts(docs, id_col, text_col).withColumn("held_out", held_out("doc_id"))
    known, model, totals, counts = fit(rows)
    shared = docs.sparkSession.sparkContext.broadcast((known, model, totals))
    found = staged(rows.mapInArrow(_scores(shared), _SCORED).withColumn("row", F.monotonically_increasing_id()), "scored")
    shared.destroy()
    far = found.select("row", F.explode(F.arrays_zip("far", "times")).alias("x")).select("row", F.col("x.far").alias("id"), F.col("x.times").alias("times"))
    # Words without a count add nothing: log10(0 + 1) is 0.
    met = far.join(counts, "id").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_counted"))
    whole = found.join(met, "row", "left")
    more, counted = F.coalesce("more", F.lit(0)), F.coalesce("more_counted", F.lit(0.0))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("seen") + more).cast("long").alias("n_known"), F.lit(totals.n).cast("long").alias("train_tokens"),
        (F.col("counted") + counted - F.col("n_tokens") * F.lit(float(np.log10(totals.n + totals.v + 1)))).alias("base_score"), (F.col("log_p") + counted).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op13: both scores of all documents."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
