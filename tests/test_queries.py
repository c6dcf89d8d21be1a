"""Every registered query against its SQL, on the smallest tables."""

import pytest
from compare import connect, difference
from conftest import SMALL
from registry import ORACLES, QUERIES
from registry.link_queries import EDITED_SQL


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


PYTHON_IN_TASKS = {"navigation_links", "page_headings"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    plan = _plan(df)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert ("Python" in plan or "InPandas" in plan) == (name in PYTHON_IN_TASKS)
    assert difference(df, duck, ORACLES[name]) is None


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = QUERIES["where_all_rules"](spark, small)._jdf.queryExecution().toString()
    assert "EqualTo(l_returnflag,R)" in plan and "l_extendedprice" not in plan.split("Physical Plan")[-1]
    plan = _plan(QUERIES["retain_history"](spark, small))
    assert "GreaterThanOrEqual(o_orderdate" in plan and "o_totalprice" not in plan


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_edited_titles_equal_comparing_all_pairs(spark, small, duck):
    got = QUERIES["similar_edited_titles"](spark, small)
    assert difference(got, duck, EDITED_SQL) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
