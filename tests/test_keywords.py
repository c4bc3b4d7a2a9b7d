"""Keyword hits by counts in tasks against the join of all terms."""

import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import keywords, retrieval
from tesserae.plans import retrieval as pr


@pytest.mark.parametrize("k", [1, 3, 50])
def test_best_hits_are_those_of_all(spark, monkeypatch, tmp_path, k):
    """Many ties, nulls, a query without terms and one without hits; small steps."""
    monkeypatch.setattr(keywords, "CELLS", 40)
    draw = random.Random(k)
    text = lambda n: " ".join(draw.choice("ab cd ef gh ij kl mn op Éa 3x".split()) for _ in range(n))
    entries = spark.createDataFrame([(f"{i % 7}:{i}", None if i % 11 == 0 else text(i % 5), None if i % 13 == 0 else text(2)) for i in range(300)], "entry_id string, content string, title string").repartition(3)
    asked = spark.createDataFrame([(1, "ab cd"), (2, "éa 3x gh ij"), (3, "the"), (4, None), (5, "nowhere"), (6, "mn")], "query_id long, query string")
    asked.write.parquet(str(tmp_path / "asked"))  # of a size that the planner knows
    asked = spark.read.parquet(str(tmp_path / "asked"))
    first = lambda hits: {tuple(r) for r in retrieval.ranked(hits, ["query_id"], [F.desc("score"), F.asc("entry_id")], k).select("query_id", "entry_id", "score", "rank").collect()}
    bounded = retrieval.keyword_hits(entries, asked, 10, k)
    assert first(bounded) == first(retrieval.keyword_hits(entries, asked, 10))
    assert bounded.count() <= 3 * k * 4  # what leaves the tasks goes by queries, not by entries


def test_ids_that_are_repeated_or_null_are_summed_as_before(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    for ids, k in (([1, 2], 5), ([1, 1], None), ([1, None], None)):
        spark.createDataFrame([(i,) for i in ids], "doc_id long").write.mode("overwrite").parquet(path)
        assert pr.told_apart(spark, str(tmp_path), 5) == k
