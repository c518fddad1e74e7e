from pathlib import Path

import pytest

from logloom import queries as q

from .oracle import compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, name):
    """Against SQL; the hulls, which SQL can't draw, have brute force in test_operators and rows here."""
    if name in q.oracle_sql():
        compare(spark, q.queries()[name], q.oracle_sql()[name], FOLDER)
    else:
        assert name in ("convex_hull_per_bag", "concave_hull_per_bag", "hulls_overlapping_polygon") and q.queries()[name](spark, FOLDER).count() > 0


def test_no_query_compares_nothing(spark):
    for name in ("nearest_point_hover", "missing_topics_anti", "mcap_islands", "time_ticks", "incremental_ledger"):
        assert q.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_plans(spark):
    """Nearest alignment has no nested-loop join, top-k per group limits before its shuffle."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan(q.queries()["nearest_alignment"](spark, FOLDER))
    assert "WindowGroupLimit" in plan(q.queries()["vector_topk_per_bag"](spark, FOLDER))
    assert "CartesianProduct" not in plan(q.queries()["point_in_polygon_cells"](spark, FOLDER))
