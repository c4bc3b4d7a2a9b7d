"""Every registered query of the engine, with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.plans import admin, admission, artefacts, citation, files, maintenance, observability, records, registry, retrieval, structure

MODULES = (retrieval, structure, citation, registry, observability, admin, artefacts, files, maintenance, admission, records)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
