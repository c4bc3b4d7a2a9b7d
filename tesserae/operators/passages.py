"""Texts that hold passages: in each task, the bytes of many texts meet all passages at once.

Each passage has an anchor, WORD of its bytes that few passages share. Every place of a text whose bytes are an anchor's is found by one
table; there the whole passage is compared, WORD bytes at a time. UTF-8 is held as bytes if and only if it is held as text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD, BITS = 8, 16
#: Bytes of texts that are looked up at once.
PIECE = 1 << 20
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The strings' bytes, one after another, and their n + 1 offsets."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def _words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """WORD bytes from each of these places, as numbers."""
    return data[at[:, None] + np.arange(WORD)].view(np.uint64)[:, 0]


def _slot(words: np.ndarray) -> np.ndarray:
    return (words * SPREAD) >> np.uint64(64 - BITS)


class Passages:
    """Passages of WORD bytes at least, ready to be looked for."""

    def __init__(self, column: pa.Array) -> None:
        self.data, cut = _bytes(column)
        self.first, self.size = cut[:-1], np.diff(cut)
        owner = np.repeat(np.arange(len(column)), self.size - WORD + 1)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(self.size - WORD + 1) - (self.size - WORD + 1), self.size - WORD + 1)
        _, which, times = np.unique(_words(self.data, self.first[owner] + inner), return_inverse=True, return_counts=True)
        order = np.lexsort((inner, times[which], owner))
        best = order[np.searchsorted(owner, np.arange(len(column)))]
        self.anchor = inner[best]
        keys = _words(self.data, self.first + self.anchor)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.table = np.zeros(1 << BITS, bool)
        self.table[_slot(keys)] = True

    def within(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of texts and of passages that they hold, each pair once."""
        data, cut = _bytes(column)
        texts, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for low in range(0, len(data) - WORD + 1, PIECE):
            for shift in range(low, low + WORD):
                words = data[shift : shift + PIECE][: (min(PIECE, len(data) - shift)) // WORD * WORD].view(np.uint64)
                at = np.flatnonzero(self.table[_slot(words)])
                if len(at):
                    text, passage = self._compared(data, cut, shift + WORD * at, words[at])
                    texts.append(text)
                    held.append(passage)
        both = np.unique(np.concatenate(texts) * len(self.size) + np.concatenate(held))
        return both // len(self.size), both % len(self.size)

    def _compared(self, data: np.ndarray, cut: np.ndarray, at: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.searchsorted(self.keys, words, "left"), np.searchsorted(self.keys, words, "right")
        n = high - low
        passage = self.order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        at = np.repeat(at, n)
        text = np.searchsorted(cut, at, "right") - 1
        start = at - self.anchor[passage]
        left = np.flatnonzero((start >= cut[text]) & (start + self.size[passage] <= cut[text + 1]))
        step, found = 0, [np.empty(0, np.int64)]
        while len(left):
            last = self.size[passage[left]] - WORD
            inner = np.minimum(step, last)
            same = _words(data, start[left] + inner) == _words(self.data, self.first[passage[left]] + inner)
            found.append(left[same & (step >= last)])
            left, step = left[same & (step < last)], step + WORD
        found = np.concatenate(found)
        return text[found], passage[found]


def _within(asked: pa.Table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages, ids = Passages(asked.column("query").combine_chunks()), asked.column("query_id").combine_chunks()
        for batch in batches:
            text, passage = passages.within(batch.column("text"))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(passage)), batch.column("document_id").take(pa.array(text))], names=["query_id", "document_id"])

    return run


def within(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, document_id of the texts that hold a passage, once for each row of texts.

    texts: document_id, text; asked: query_id, query (WORD bytes at least), of a size that may be broadcast, as the caller has
    checked: tasks get them as one table.
    """
    table, kinds = asked.select("query_id", "query").toArrow(), (dict(asked.dtypes)["query_id"], dict(texts.dtypes)["document_id"])
    rows = texts.select("document_id", "text").where(F.col("text").isNotNull())
    if not table.num_rows:
        return rows.where("false").select(F.lit(None).cast(kinds[0]).alias("query_id"), "document_id")
    return rows.mapInArrow(_within(table), f"query_id {kinds[0]}, document_id {kinds[1]}")
