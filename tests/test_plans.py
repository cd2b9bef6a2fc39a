"""Plans keep their shape: filters and columns reach the scan, groups are cut before the shuffle, no pairs of all rows."""

import re

import pytest
from pyspark.sql import functions as F

from sievelake.operators.latest import latest_by
from sievelake.plans import registry
from sievelake.session import table

SF = "/root/testdata/sf0.001"
#: One aggregated row, or a few stated queries, beside a table.
SMALL_SIDE = {"inbox_page", "constrained_choice", "cosine_nearest"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_pairs_of_all_rows(spark, name):
    text = plan(registry.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text
    assert name in SMALL_SIDE or "NestedLoop" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = registry.QUERIES["negative_marks"](spark, SF)._jdf.queryExecution().toString()
    assert re.search(r"ReadSchema: struct<o_orderkey:\w+,o_custkey:\w+,o_orderdate:\w+,o_orderpriority:\w+>", text)
    text = registry.QUERIES["like_ranked"](spark, SF)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in text and "p_type" not in re.search(r"ReadSchema: (.*)", text)[1]
    rows = table(spark, SF, "orders").where(F.col("o_orderstatus") == "F").select("o_orderkey")
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in rows._jdf.queryExecution().toString()


def test_groups_are_cut_before_the_shuffle(spark):
    text = plan(latest_by(table(spark, SF, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]))
    assert text.count("WindowGroupLimit") == 2


def test_many_conditions_are_one_shuffle(spark):
    text = registry.QUERIES["saved_search_counts"](spark, SF)._jdf.queryExecution().toString()
    assert "Expand" not in plan(registry.QUERIES["saved_search_counts"](spark, SF)) and "hashpartitioning(o_custkey" in text


def test_suppliers_are_few_before_they_meet_customers(spark):
    """A nation's suppliers and customers were joined row by row, which grows with the square of the tables."""
    text = registry.QUERIES["company_reconcile"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    join = text.index("Join Inner")
    assert "distinct" not in text and "max(s_suppkey" in text[join:] and "s_suppkey" not in text[:join]


def test_one_value_or_several_without_a_row_for_each(spark):
    """Several distinct counts made each line five rows or more before the shuffle."""
    text = plan(registry.QUERIES["merged_groups"](spark, SF))
    assert "Expand" not in text and text.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["reconciled_status", "stale_by_source"])
def test_groups_are_dealt_before_they_are_held(spark, name):
    """A task grouped, or sorted, all lines of its split."""
    text = plan(registry.QUERIES[name](spark, SF))
    assert "Expand" not in text and "REPARTITION_BY_NUM" in text
