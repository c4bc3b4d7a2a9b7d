"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm._shared import staged

#: Edges to a file: small rounds aren't written as many tiny ones.
PER_FILE = 200_000


def _files(edges: int) -> int:
    return edges // PER_FILE + 1


def _side(table: DataFrame, files: int) -> DataFrame:
    """A side of a join; broadcast, if at all, only while the edges fit one file."""
    return table.hint("merge") if files > 1 else table


def _large(edges: DataFrame, files: int) -> DataFrame:
    """Every node ties its larger neighbours to the least of itself and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")).coalesce(files), "large")
    return both.where("b > a").join(_side(least, files), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small(edges: DataFrame, files: int) -> DataFrame:
    """Every node ties its smaller neighbours and itself to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = staged(down.groupBy("a").agg(F.min("b").alias("m")).coalesce(files), "small")
    rest = down.join(_side(least, files), "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(a, root) for every node of edges (a, b: long) but the roots: the least node of its component.

    Each round is written to the shared folder, so a lost executor costs at most a round.
    """
    now = staged(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, files = None, _files(now.count())
    for _ in range(rounds):
        now = staged(_small(staged(_large(now, files).coalesce(files), "stars"), files).coalesce(files), "edges")
        sign = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if sign == before:
            return now.select("a", F.col("b").alias("root"))
        before = sign
    raise RuntimeError(f"no convergence after {rounds} rounds")
