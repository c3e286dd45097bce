"""Every registered query next to its SQL twin, and the shape of key plans."""

import check_oracle
import pytest

import __spark_entry__ as entry
from textscore.plans.registry import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return check_oracle.connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, sf, name):
    outcome = check_oracle.compare(spark, con, sf, name)
    assert not outcome.startswith("FAIL"), outcome
    assert not outcome.endswith(" 0")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_plans_have_no_row_python_and_no_pairing(spark, sf, name):
    plan = plan_of(entry.queries()[name](spark, sf))
    assert "BatchEvalPython" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["undersample", "sample_per_group", "reduce_per_category", "random_split"])
def test_cuts_do_not_shuffle_the_rows(spark, sf, name):
    plan = plan_of(entry.queries()[name](spark, sf))
    exchanges = [line for line in plan.splitlines() if " Exchange " in line and "REPARTITION_BY_NUM" not in line]
    assert not exchanges
    assert "SinglePartition" not in plan and "Window" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = plan_of(entry.queries()["score_range_by_group"](spark, sf))
    assert "text" not in plan.split("ReadSchema: ")[1].split("\n")[0]
