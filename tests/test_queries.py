"""Every registered query against its SQL on an independent engine."""

from __future__ import annotations

import os

import pytest
from compare import differences, sql_connection

import __spark_entry__ as contract
from tillfloor.plans.oracles import ORACLES
from tillfloor.plans.queries import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    return sql_connection(DATA)


def _plan(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= contract.queries().items() and ORACLES.items() <= contract.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sql, name):
    result = contract.queries()[name](spark, DATA)
    assert differences(result, sql, contract.oracle_sql()[name]) == []
    plan = _plan(result)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert operator not in plan


def test_scans_read_and_filter_only_what_they_need(spark):
    plan = _plan(contract.queries()["logged_stops"](spark, DATA))
    assert "PushedFilters: [IsNotNull(value), GreaterThanOrEqual(value,3.0)]" in plan
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>" in plan
    plan = _plan(contract.queries()["kpi_product"](spark, DATA))
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double>" in plan


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["kpi_product", "oee_daily", "min_lot_carry", "reason_coding"])
def test_same_result_with_one_shuffle_partition(spark, sql, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        result = contract.queries()[name](spark, DATA)
        assert differences(result, sql, contract.oracle_sql()[name]) == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", [
    "kpi_product", "kpi_weekday", "batch_oee", "stop_cap", "stop_intervals", "scrap_costop", "dim_product",
    "product_share", "profile_describe", "coverage_share",
])
def test_same_result_without_broadcast(spark, sql, name):
    """The plan of large tables: sort-merge joins in place of broadcasts."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        result = contract.queries()[name](spark, DATA)
        assert differences(result, sql, contract.oracle_sql()[name]) == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
