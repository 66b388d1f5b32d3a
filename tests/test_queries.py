"""Every registered query of the library against its SQL, and those without one for rows."""

import pytest

from clausemill.plans import catalog
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, name):
    assert_same(catalog.queries()[name](spark, SF), catalog.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_gives_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert catalog.flagship(spark, SF).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.queries()["boundary_rule_filter"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<item_id:bigint,text:string>" in plan
    plan = catalog.queries()["gap_anti_join"](spark, SF)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(l_quantity,50.0)" in plan


def test_ranks_are_bounded_before_the_shuffle(spark):
    plan = catalog.queries()["known_first_budget"](spark, SF)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan.split("Physical Plan")[-1]
