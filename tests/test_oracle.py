"""Every registered query with SQL gives the rows of its SQL."""

import pytest

import __spark_entry__ as registry
from eventide.plans.queries import QUERIES

from .oracle import differences

SQL = {k: v for k, v in registry.oracle_sql().items() if k in QUERIES}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, small, name):
    assert differences(spark, small, QUERIES[name], SQL[name]) == ""


def test_flagship(spark):
    assert registry.entry(spark).limit(1).count() == 1


def test_names(spark):
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_the_log_is_written_once(spark, small):
    """Candidates are counted from the written log, whose events aren't shuffled to meet the few selected entities."""
    plan = QUERIES["event_frequency_topm"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and plan.count("FileScan") == 2 and "SortMergeJoin" not in plan
