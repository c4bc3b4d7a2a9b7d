"""Tables in the shared folder."""

import pytest

from tesserae.llm import ngram_join
from tesserae.llm._shared import clear, few_files, shared_dir, staged


def test_staged_and_clear(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    table = staged(spark.range(5), "numbers")
    assert table.count() == 5 and table.inputFiles()[0].startswith(shared_dir(spark))
    clear(spark)
    with pytest.raises(Exception, match="does not exist|PATH_NOT_FOUND|FileNotFound|FILE_NOT_EXIST"):
        spark.read.parquet(table.inputFiles()[0]).count()


def test_small_tables_are_few_files(spark, docs, monkeypatch):
    """However many tasks an exchange has, a table of a row a document is written as files by its rows."""
    written = {}

    def told(df, name):
        table = staged(df, name)
        written[name] = len(table.inputFiles())
        return table

    monkeypatch.setattr(ngram_join, "staged", told)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert ngram_join.representatives(docs).count() > 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {k: n for k, n in written.items() if k in ("blocks", "classes", "least", "named", "gone", "again") and n > 1} == {}
    assert len(staged(few_files(spark.range(0, 45_000, 1, 8), 45_000), "numbers").inputFiles()) == 3
