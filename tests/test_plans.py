"""Plans of structure queries: what the windows of the hierarchy carry."""

import pytest

from tesserae.plans import artefacts as pl
from tesserae.plans import structure as ps


@pytest.mark.parametrize("name", ["node_path", "tree_violations"])
def test_hierarchy_sorts_no_texts(spark, sf_dir, name):
    """Windows over parents and depths carried texts and titles to the end, where numbers were taken from them."""
    plan = ps.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    after = [line for line in plan.splitlines() if "Project [" in line and "parent#" in line.split("AS parent#")[-1] or "AS depth#" in line]
    assert after and not any("text#" in line or "title#" in line for line in after)


def test_only_chunks_are_joined_with_orders(spark, sf_dir):
    """Vectors and entries were joined with orders too, for documents that nobody asked for."""
    plan = pl.QUERIES["chunk_coverage"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("o_orderkey#") and plan.count("Join Inner") == 1
