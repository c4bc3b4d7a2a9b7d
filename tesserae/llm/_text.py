"""Vectorised word tools over the UTF-8 buffers of Arrow string columns.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; UTF-8 keeps these bytes out of
multi-byte characters, so byte offsets and the code-point definition agree.
Hashes are Rabin-Karp polynomials modulo 2**64 with an odd base, finished by a bit mixer.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Text bytes that are worked on at once; a longer document is worked on alone.
BLOCK = 1 << 20

_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finishes a 64-bit hash, so that close inputs give unrelated outputs."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _pow(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept and grown as needed."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _powers[base] = (both[0], both[1])
    return have


def windows(values: np.ndarray, k: int, base: int = _WORD_BASE) -> np.ndarray:
    """Rabin-Karp hash of every k consecutive values; len(values) - k + 1 of them."""
    n = len(values)
    if n < k:
        return np.empty(0, np.uint64)
    up, down = _pow(base, n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * up[:n], out=total[1:])
    return mix((total[k:] - total[: n - k + 1]) * down[: n - k + 1])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offs = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if at is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offs - offs[0]


def pieces(batches: Iterator[pa.RecordBatch], name: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts the batches so that each holds at most BLOCK bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = buffers(batch.column(batch.schema.get_field_index(name)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + BLOCK, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


class Words:
    """The words of a few documents: byte spans, hashes, and the span of words of each document.

    fold: lower-case A-Z first.
    """

    def __init__(self, column: pa.Array, fold: bool = False, hashes: bool = True):
        data, offs = buffers(column)
        if fold and len(data):
            data = data + (((data >= 65) & (data <= 90)) * np.uint8(32)).astype(np.uint8)
        self.data, self.offs, self.n_docs = data, offs, len(offs) - 1
        if len(data):
            inside = ~SPACE[data]
            edge = np.zeros(len(data) + 1, bool)
            edge[offs] = True
            start = inside.copy()
            start[1:] &= ~inside[:-1] | edge[1:-1]
            end = inside
            end = end.copy()
            end[:-1] &= ~inside[1:] | edge[1:-1]
            self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        else:
            self.starts = self.ends = np.empty(0, np.int64)
        #: Words first[d]:first[d + 1] belong to document d.
        self.first = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.first)
        self.hashes = self._hash() if hashes else None

    def _hash(self) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        i = 0
        while i < len(out):  # a block of bytes at a time, to bound memory in very long documents
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + 4 * BLOCK, "right")))
            lo, hi = self.starts[i], self.ends[j - 1]
            up, down = _pow(_BYTE_BASE, int(hi - lo))
            total = np.empty(hi - lo + 1, np.uint64)
            total[0] = 0
            np.cumsum((self.data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=total[1:])
            a, b = self.starts[i:j] - lo, self.ends[i:j] - lo
            out[i:j] = mix((total[b] - total[a]) * down[a])
            i = j
        return out

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the k-word windows that lie in one document, their first words, their documents."""
        h = windows(self.hashes, k)
        if not len(h):
            return h, np.empty(0, np.int64), np.empty(0, np.int64)
        doc = self.doc_of()
        ok = np.flatnonzero(doc[: len(h)] == doc[k - 1 :])
        return h[ok], ok, doc[ok]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    if len(x) < w:
        return x[:0]
    span, out = 1, x
    while 2 * span <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < w:
        out = np.minimum(out[: len(x) - w + 1], out[w - span : w - span + len(x) - w + 1])
    return out


def cuts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def flat(chunks: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(chunks) if chunks else np.empty(0, dtype)


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return x.view(np.int64)


def take(chunk: Iterator, n: int) -> list:
    return list(itertools.islice(chunk, n))
