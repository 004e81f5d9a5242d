"""Every query with SQL gives the rows of that SQL; the others give rows."""

from __future__ import annotations

import pytest

from bracketry.plans import registry
from tests import oracle

SMALL = f"{oracle.DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SMALL)
    if name in registry.SQL:
        assert oracle.difference(df, con, registry.SQL[name]) == ""
    else:
        assert df.count() > 0


def test_no_query_joins_row_by_row(spark):
    """No nested loops but against one-row tables."""
    for name in ("q_interval_join", "q_common_neighbours", "q_asof_strict", "q_asof_calendar", "q_opponent_tier_two_pass", "q_mentions"):
        plan = registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
