"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import ann, byte_bpe, license_scan, lm_scoring, ngram_join, packing, phrases, pii, quality_rules, secret_scan, sharding, substring_dedup, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": ngram_join.query,
    "op2_pii": pii.query,
    "op3_quality_rules": quality_rules.query,
    "op4_license_scans": license_scan.query,
    "op5_sharding": sharding.query,
    "op6_additive_ann": ann.query,
    "op7_secret_scans": secret_scan.query,
    "op8_packing": packing.query,
    "op9_byte_bpe": byte_bpe.query,
    "op10_substring_dedup": substring_dedup.query,
    "op11_whitening": whitening.query,
    "op12_collocations": phrases.query,
    "op13_lm_scoring": lm_scoring.query,
}

SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": ngram_join.SQL,
    "op4_license_scans": license_scan.SQL,
    "op7_secret_scans": secret_scan.SQL,
    "op10_substring_dedup": substring_dedup.SQL,
    "op12_collocations": phrases.SQL,
}
