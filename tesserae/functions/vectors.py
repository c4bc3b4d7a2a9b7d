"""Similarities of array columns, and the deterministic test embedder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda z, x: z + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors that are empty, of zero norm or of different lengths."""
    bad = (F.size(a) == 0) | (F.size(a) != F.size(b)) | (norm(a) == 0) | (norm(b) == 0)
    return F.when(bad, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)))


def euclid(a: Column, b: Column) -> Column:
    """1 / (1 + distance)."""
    return 1 / (1 + F.sqrt(_sum(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)))))


SIMILARITIES: dict[str, Callable[[Column, Column], Column]] = {"cosine": cosine, "dot": dot, "euclid": euclid}


def test_embedding(text: Column, dimension: int = 384) -> Column:
    """Unit vector from a chain of SHA-256 digests of the text, a byte for each component."""
    rounds = -(-dimension // 32)
    seed = F.struct(F.sha2(text.cast("binary"), 256).alias("seed"), F.lit("").alias("out"))

    def step(z: Column, _: Column) -> Column:
        new = F.sha2(F.unhex(z["seed"]), 256)
        return F.struct(new.alias("seed"), F.concat(z["out"], new).alias("out"))

    digits = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), seed, step, lambda z: z["out"])
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1)
    return F.get(F.transform(F.array(raw), lambda v: F.transform(v, lambda x: x / norm(v))), 0)
