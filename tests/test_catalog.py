import pytest

import __spark_entry__ as entry
import check
from oracle_queries import ORACLES
from tallyloom.plans.catalog import QUERIES

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con(folder):
    return check.connect(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_its_sql(spark, con, folder, name):
    assert check.compare(spark, con, name, folder) == ""


@pytest.mark.parametrize("name", NAMES)
def test_no_query_pairs_all_rows(spark, folder, name):
    plan = entry.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_every_query_has_sql_and_the_flagship_runs(spark):
    assert set(ORACLES) == set(NAMES)
    assert set(NAMES) <= set(entry.queries()) and set(NAMES) <= set(entry.oracle_sql())
    flagship = entry.entry(spark)
    assert flagship.columns == ["problem_id", "answer"] and flagship.count() > 0
