"""The pipeline's stages, each on what its predecessor kept, against plain versions of their decisions."""

from collections import Counter

import brute
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm import quality_rules
from tesserae.llm._shared import staged


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.01"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, sf), name)
        out.append(docs)
    return out


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "secrets", "packing"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_quality(spark, stages):
    want = {r.doc_id for r in quality_rules.query(spark, "/root/testdata/sf0.01").where("kept").collect()}
    assert {d for d, _ in rows(stages[1])} == want


def test_near_duplicates(stages):
    want = {doc for doc, _, component in brute.jaccard(rows(stages[1])) if doc == component}
    assert {d for d, _ in rows(stages[2])} == want


def test_repeated_passages(stages):
    got = Counter((d, brute.sha(" ".join(brute.words(t)).encode())) for d, t in rows(stages[3]))
    assert got == Counter({(d, h): n for (d, _, _, h), n in brute.dedup(rows(stages[2])).items()})


def test_secrets(stages):
    before, after = dict(rows(stages[3])), dict(rows(stages[4]))
    for doc, text in before.items():
        assert not brute.secrets(after[doc])
        if not brute.secrets(text):
            assert after[doc] == text


def test_packing(stages):
    from test_ops import pieces_ok

    pieces_ok(stages[5].collect(), rows(stages[4]))


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.01").count() == stages[5].count()


def test_columns_clash(spark, docs, case_dir):
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, case_dir)
        assert kept.columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, kept, case_dir).count() >= 0


def test_empty_tables(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_batches_are_small(spark):
    """Texts go to Python workers a few megabytes at a time, not a whole task at once; a longer text goes alone."""
    texts = spark.range(0, 24, 1, 1).select("id", F.repeat(F.lit("word "), F.when(F.col("id") == 12, 1_200_000).otherwise(100_000)).alias("text"))
    corpus_pipeline.repeated_passages(spark, texts.withColumnRenamed("id", "doc_id"), "")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([sum(len(x.as_py()) for x in b.column("text"))])], names=["rows", "size"])

    found = texts.mapInArrow(sizes, "rows long, size long").collect()
    assert sum(r["rows"] for r in found) == 24 and max(r["size"] for r in found) <= 6_000_000 + corpus_pipeline.BATCH and max(r["size"] for r in found if r["size"] < 6_000_000) <= corpus_pipeline.BATCH + 500_000
