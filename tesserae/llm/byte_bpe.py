"""Byte-level BPE by a sentencepiece model that is serialised from a rank file.

Each byte is mapped to one printable character, as byte-level vocabularies do; every entry of the rank file becomes
a piece of such characters with score -rank, so that sentencepiece merges in the order of ranks. Normalisation is the
identity, without prefix or escapes. A text is split into pre-tokens first; each is encoded by itself. Decoding maps
pieces back to bytes.

A pre-token that is an entry as a whole takes its id, as rank encoders do, even if no merges lead to it.

Defined cases: a null text counts as empty, with no ids; white space or letters of any length are one pre-token.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm._shared import texts
from tesserae.llm._text import pieces

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens remembered by a worker, and the longest one that is.
REMEMBERED, LONGEST = 500_000, 48


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _field(number: int, value: bytes | str | int | float) -> bytes:
    """A protocol-buffer field."""

    def number_bytes(n: int) -> bytes:
        out = bytearray()
        while n > 0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, int):
        return number_bytes(number << 3) + number_bytes(value)
    if isinstance(value, float):
        return number_bytes(number << 3 | 5) + struct.pack("<f", value)
    raw = value.encode() if isinstance(value, str) else value
    return number_bytes(number << 3 | 2) + number_bytes(len(raw)) + raw


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model: piece 0 is unknown, piece i + 1 is the i-th entry by rank."""
    of = byte_characters()
    unknown, bpe = 2, 2
    out = [_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, unknown))]
    for entry, rank in sorted(ranks.items(), key=lambda x: x[1]):
        out.append(_field(1, _field(1, "".join(of[b] for b in entry)) + _field(2, float(-rank))))
    out.append(_field(2, _field(3, bpe)))
    out.append(_field(3, _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class ByteBpe(dict):
    """Pre-token -> its ids as little-endian 32-bit numbers; fills itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        super().__init__()
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no entry for the bytes {missing}: texts that hold them could not be encoded")
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(ranks))
        self.split = regex.compile(pattern).findall
        by_rank = sorted(ranks, key=ranks.__getitem__)
        self.ids = np.array([0, *(ranks[x] for x in by_rank)], "<u4")
        self.bytes_of = dict(zip(self.ids[1:].tolist(), by_rank, strict=True))
        self.to_characters = dict(enumerate(byte_characters()))
        self.entries = {x: struct.pack("<I", ranks[x]) for x in by_rank}

    def __missing__(self, token: str) -> bytes:
        raw = token.encode()
        found = self.entries.get(raw)
        if found is None:
            found = self.ids[self.model.encode(raw.decode("latin-1").translate(self.to_characters))].tobytes()
        if len(token) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = found
        return found

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(read_ranks(path), pattern)


def _binary(values: Iterable[bytes]) -> pa.Array:
    return pa.array(list(values), pa.binary())


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (little-endian 32-bit numbers), and with decoded, the ids' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in pieces(batches):
            ids = [own.encode(t) for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), _binary(ids)]
            yield pa.RecordBatch.from_arrays(columns + [_binary(map(own.decode, ids))] * decoded, names=["doc_id", "n_tokens", "ids"] + ["decoded"] * decoded)

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            out = [None if x is None else own.decode(x).decode(errors="replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: doc_id, n_tokens, ids_sha256, decoded_sha256 of all documents."""
    import public_tokenizers

    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
