"""Packing: window-filling length combinations by non-negative least squares.

A document's ids are cut into full windows and a rest; full windows are sequences as they are. Rests are packed
by their length histogram alone, whose size is bounded by the window:

1. Enumerate shallow combinations of lengths that fill a window: a length with its complement, and triples with
   their third length given by the other two, over the most frequent lengths.
2. Solve for repeat counts that explain the histogram, non-negative least squares, by projected coordinate steps.
3. Round the counts down to what the histogram holds; pack what is left greedily, best fit by decreasing length.

The plan is a table of runs: the rests of one length with ranks in [from, to) go to consecutive sequences at one
offset. A task numbers its own pieces of each length; what the tasks before it hold of a length is added to
that, so no task ranks a whole length and no piece is shuffled for its rank.

Defined cases: a null or empty text has only the closing id; rows that repeat an id are packed each.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm._shared import staged, texts
from tesserae.llm._text import pieces

WINDOW, END_ID = 1024, 0
#: Lengths that triples are made of, and sweeps of the solver.
FREQUENT, SWEEPS = 96, 60
PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
RANKS, JSON = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"


@cache
def _encoder():
    """The vocabulary's fast encoder; its ids equal those of the JSON file but for the texts that ``encode`` sends there."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("window", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def _exact():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(JSON))


#: Texts that hold it go through the slower library, which gives its id 50256.
SPECIAL = "<|endoftext|>"
#: So do texts with a run of white space that overflows the fast encoder's stack.
_blank = re.compile(r"\s{5000}")


def encode(text: str) -> np.ndarray:
    """Ids of a text as the tokenizers library gives them, without special tokens added."""
    if SPECIAL in text or (len(text) > 5000 and _blank.search(text)):
        return np.array(_exact().encode(text, add_special_tokens=False).ids, np.uint32)
    return np.array(_encoder().encode_ordinary(text), np.uint32)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seen = TaskContext.get().partitionId(), np.zeros(WINDOW + 1, np.int64)
    for batch in pieces(batches):
        start, length, crc, total, own, sizes = [], [], [], [], [], []
        for text in batch.column("text").to_pylist():
            ids = np.append(encode(text), np.uint32(END_ID)).astype("<u4")
            at = range(0, len(ids), WINDOW)
            for i in at:
                n = min(WINDOW, len(ids) - i)
                length.append(n)
                own.append(seen[n])
                seen[n] += 1
                crc.append(zlib.crc32(ids[i : i + WINDOW].tobytes()))
            start += at
            total += [len(ids)] * len(at)
            sizes.append(len(at))
        row = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
        columns = [batch.column("doc_id").take(row), *[pa.array(x, pa.int64()) for x in (start, length, crc, total, own)], pa.array(np.full(len(row), part, np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=[*PIECE, "own", "part"])


def combinations(histogram: dict[int, int], window: int) -> list[tuple[int, ...]]:
    """Shallow combinations of present lengths that fill the window: pairs, and triples of frequent lengths."""
    have = sorted(histogram)
    out = {(x, window - x) for x in have if window - x in histogram and x <= window - x}
    often = sorted(sorted(have, key=lambda x: (-histogram[x], x))[:FREQUENT])
    for i, x in enumerate(often):
        for y in often[i:]:
            if window - x - y >= y and window - x - y in histogram:
                out.add((x, y, window - x - y))
    return sorted(out)


def repeats(histogram: dict[int, int], found: list[tuple[int, ...]]) -> np.ndarray:
    """Non-negative x with the least squared gap between the lengths that x combinations use and the histogram."""
    at = {x: i for i, x in enumerate(sorted(histogram))}
    gap = np.array([histogram[x] for x in sorted(histogram)], float)
    rows = [np.unique([at[x] for x in c], return_counts=True) for c in found]
    x = np.zeros(len(found))
    for _ in range(SWEEPS):
        moved = 0.0
        for k, (i, n) in enumerate(rows):
            new = max(0.0, x[k] + (gap[i] @ n) / (n @ n))
            gap[i] -= (new - x[k]) * n
            moved = max(moved, abs(new - x[k]))
            x[k] = new
        if moved < 0.01:
            break
    return x


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, last rank + 1, first sequence, offset) that place every length's ranks once."""
    left = {k: v for k, v in histogram.items() if v > 0}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(length: int, n: int, offset: int) -> None:
        runs.append((length, used[length], used[length] + n, sequences, offset))
        used[length] += n
        left[length] -= n

    found = combinations(left, window)
    for c, x in sorted(zip(found, repeats(left, found), strict=True), key=lambda cx: (-cx[1], cx[0])):
        n = min([int(x + 1e-9), *(left[v] // c.count(v) for v in c)])
        if n > 0:
            offset = 0
            for v in c:
                place(v, n, offset)
                offset += v
            sequences += n
    rest = sorted(v for v in left if left[v])
    while rest:  # the longest rest opens a sequence; the longest that still fits goes in, again and again
        chosen, room, taken = [], window, dict.fromkeys(rest, 0)
        i = len(rest) - 1
        while room and i >= 0:
            v = rest[i]
            if v <= room and taken[v] < left[v]:
                chosen.append(v)
                taken[v] += 1
                room -= v
            else:
                i = min(i, bisect.bisect_right(rest, room)) - 1
        n = min(left[v] // k for v, k in taken.items() if k)  # as often as these lengths last
        offset = 0
        for v in chosen:
            place(v, n, offset)
            offset += v
        sequences += n
        rest = [v for v in rest if left[v]]
    return runs


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded (length of its sequence)."""
    cut = staged(texts(docs, id_col, text_col).mapInArrow(_cut, _longs([*PIECE, "own"]) + ", part int"), "pieces")
    counts = staged(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most WINDOW rows
    full = histogram.pop(WINDOW, 0)
    runs = plan(histogram)
    runs.append((WINDOW, 0, full, max((first + hi - lo for _, lo, hi, first, _ in runs), default=0), 0))
    ranked = cut.join(staged(bases, "bases"), ["length", "part"]).withColumn("rank", F.col("base") + F.col("own"))
    return _placed(ranked, runs)


def _longs(names: list[str]) -> str:
    return ", ".join(f"{n} long" for n in names)


def _padded(n: int) -> int:
    """Sequences are padded to the window, except at a power of two."""
    return n if n & (n - 1) == 0 else WINDOW


def _placed(ranked: DataFrame, runs: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Looks up the run of each (length, rank); the plan's size is bounded."""
    ends: dict[int, int] = {}  # runs that start at one sequence fill it together
    for length, _, _, first, offset in runs:
        ends[first] = max(ends.get(first, 0), offset + length)
    order = sorted(runs)
    key = np.array([(r[0] << 44) + r[1] for r in order], np.int64)
    low, first, offset = (np.array([r[k] for r in order], np.int64) for k in (1, 3, 4))
    end = np.array([_padded(ends[r[3]]) for r in order], np.int64)
    names = [*PIECE, "sequence_id", "offset", "padded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(key, (batch.column("length").to_numpy() << 44) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in PIECE], pa.array(first[at] + rank - low[at]), pa.array(offset[at]), pa.array(end[at])], names=names)

    return ranked.select(*PIECE, "rank").mapInArrow(run, _longs(names))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the pieces of all documents and their places."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
