"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents. ``run`` writes every stage as Parquet to the shared folder and reads it again.

Defined cases, for all stages: an empty table gives an empty one; a null text counts as empty, which the quality rules
reject; a null lang or source is a group of its own; texts of any length are worked on whole; of rows that repeat an id
and a text one stays, rows that repeat an id with other texts are documents of their own, and rows without an id pass
the near-duplicate stage; columns beside doc_id, text, lang and source are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import ngram_join, packing, quality_rules, secret_scan, substring_dedup
from tesserae.llm._shared import staged


#: Bytes of an Arrow batch on its way to a Python worker: a whole task's texts in one batch would lie in the executor and in
#: its worker at once, and are cut to blocks there anyway.
BATCH = 4 << 20


def _small_batches(spark: SparkSession) -> None:
    """From now on this session's batches hold about BATCH bytes, or one row; a size that the user has set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH))


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text that a stage has changed."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.select(*[F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality rules reject."""
    _small_batches(spark)
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates keeps the document with the smallest id."""
    _small_batches(spark)
    return ngram_join.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages that also start in a document with a smaller id."""
    _small_batches(spark)
    return _measured(substring_dedup.strip(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark."""
    return _measured(secret_scan.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' ids into sequences."""
    _small_batches(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secrets", secrets),
    ("packing", packed),
]

#: Minimum covariance determinants can't be stated in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
