"""Plans with broadcast off: attributes that a query does not read cost no scan and no join."""

from __future__ import annotations

import os
import re

import pytest

from tillfloor.plans.queries import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture()
def plan(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def text(name: str) -> str:
        return QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()

    yield text
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_are_counted_without_a_join(plan):
    assert "Join" not in plan("profile_shape")


@pytest.mark.parametrize("name", ["profile_rare_values", "clean_price_text", "clean_funnel"])
def test_no_scan_of_the_orders(plan, name):
    assert "orders.parquet" not in plan(name)


@pytest.mark.parametrize("name", ["kpi_product", "sales_totals", "price_audit", "top30_products"])
def test_lines_are_summed_below_the_join_to_parts(plan, name):
    text = plan(name)
    below = text[re.search("SortMergeJoin", text).start() :]
    assert "HashAggregate" in below and "sum(l_quantity" in below
