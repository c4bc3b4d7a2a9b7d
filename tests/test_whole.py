"""Registered queries against their SQL over tables that are larger than those of test_oracles."""

import duckdb
import pytest

from tesserae.plans import catalogue

SF = "/root/testdata/sf0.01"


def both(spark, name):
    sql, con = catalogue.oracle_sql()[name], duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in ("customer", "orders", "lineitem", "events", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalogue.queries()[name](spark, SF)
    other = con.sql(sql)
    at = [other.columns.index(c) for c in df.columns]
    return sorted(repr(tuple(r)) for r in df.collect()), sorted(repr(tuple(r[i] for i in at)) for r in other.fetchall())


@pytest.mark.parametrize("name", ["authorized_scope", "scope_status", "state_transitions", "current_states", "first_claims", "job_list"])
def test_all_rows(spark, name):
    mine, theirs = both(spark, name)
    assert mine == theirs


def test_every_order_is_a_request(spark):
    rows = catalogue.queries()["scope_status"](spark, SF)
    assert rows.count() == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_every_lineitem_is_an_event(spark):
    rows = catalogue.queries()["state_transitions"](spark, SF)
    assert rows.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
