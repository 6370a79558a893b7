"""The planned plant as a whole, and references with true orphans of every kind."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tillfloor.operators import plant
from tillfloor.plans.star import Star
from tillfloor.schemas import STAR_TABLES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def star(spark):
    return Star(spark, DATA)


def test_every_declared_column_of_every_table(star):
    for name, table in star.planned_tables().items():
        assert table.columns == STAR_TABLES[name].names


def test_laid_minutes_fill_what_was_not_run(star):
    balance = plant.minute_balance(star.planned_batch_fact, star.planned_downtime_fact)
    assert balance.where("not balanced").count() == 0 < balance.where("laid_minutes > 0").count()


def test_stops_follow_each_other_inside_their_batch(star):
    stops = star.planned_downtime_fact.collect()
    windows = {r.batch_id: (r.actual_start_ts, r.actual_end_ts) for r in star.planned_batch_fact.collect()}
    by_batch = {}
    for s in stops:
        by_batch.setdefault(s.batch_id, []).append((s.start_ts, s.end_ts))
    for batch, laid in by_batch.items():
        laid.sort()
        assert laid[0][0] == windows[batch][0] and laid[-1][1] <= windows[batch][1]
        assert all(a[1] == b[0] for a, b in zip(laid, laid[1:], strict=False))
    assert len({s.downtime_id for s in stops}) == len(stops)


def test_machine_of_a_batch_is_the_routing_and_no_terms_are_missing(star):
    routed = {r.product_id: r.machine_id for r in star.dim_product.collect()}
    rows = star.planned_batch_oee.collect()
    assert rows and all(r.machine_id == routed[r.product_id] for r in rows)
    assert all(0 < r.availability <= 1 and 0 < r.performance <= 1 and 0 < r.quality <= 1 for r in rows)


def test_a_stop_that_is_cut_short_is_not_logged(spark):
    ts = dt.datetime(2024, 1, 1, 8)
    stops = spark.createDataFrame(
        [("D1", "b", 1, ts, 100.0, "02"), ("D2", "b", 4, ts, 4.0, "03"), ("D3", "c", 3, ts, 9.0, "98")],
        "downtime_id string, batch_id string, event_no long, start_ts timestamp_ntz, duration_minutes double, true_reason_code string",
    )
    batches = spark.createDataFrame([("b", 40.0), ("c", 40.0)], "batch_id string, planned_production_minutes double")
    got = {r.downtime_id: r for r in plant.capped_stops(stops, batches).collect()}
    assert got["D1"].was_logged and got["D1"].capped_minutes == pytest.approx(100 * 34 / 104)
    assert not got["D2"].was_logged and got["D2"].reported_reason_code == "03"
    assert got["D3"].reported_reason_code == "99" and got["D3"].reported_duration_minutes == 10.0


def test_references_with_orphans(spark):
    key = "k long"
    parents = {"batch": spark.createDataFrame([(1,), (2,), (2,), (None,)], key), "product": spark.createDataFrame([(7,)], key)}
    children = {
        "stop": (spark.createDataFrame([(1,), (1,), (5,), (5,), (6,), (None,)], key), "k", "batch"),
        "inspection": (spark.createDataFrame([(2,)], key), "k", "batch"),
        "batch": (spark.createDataFrame([(7,), (8,)], key), "k", "product"),
        "none": (spark.createDataFrame([], key), "k", "product"),
    }
    got = {r[0]: tuple(r)[1:] for r in plant.references(parents, children).collect()}
    assert got == {"stop": (6, 4, 2), "inspection": (1, 0, 0), "batch": (2, 1, 1), "none": (0, 0, 0)}


def test_references_combine_keys_before_the_shuffle(spark):
    child = spark.range(0, 1000, 1, 4).select((F.col("id") % 2).alias("k"))
    frame = plant.references({"p": spark.range(1).toDF("k")}, {"r": (child, "k", "p")})
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "partial_count" in plan
    assert [tuple(r) for r in frame.collect()] == [("r", 1000, 500, 1)]
