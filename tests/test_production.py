from __future__ import annotations

import datetime as dt

import pytest

from tillfloor import schemas
from tillfloor.operators import checks, downtime, oee
from tillfloor.plans.star import kpi_views
from tillfloor.sources.inline import machine_table

DAY = dt.date(2021, 1, 4)
AT = dt.datetime(2021, 1, 4, 2)


def batch(key, planned, run, good, scrap, product=1, machine=1, day=DAY):
    end = AT + dt.timedelta(minutes=planned)
    return (key, day, product, machine, good + scrap, 1.0, AT, end, planned, AT, end, run, good,
            scrap)


def stop(key, batch_id, minutes, reported, true, code, logged=True, machine=1):
    label = "x"
    return (key, batch_id, machine, DAY, AT, AT, minutes, reported, code, label, true, label,
            logged)


def batches(spark, rows):
    return spark.createDataFrame(rows, schemas.FACT_BATCH)


def stops(spark, rows):
    return spark.createDataFrame(rows, schemas.FACT_DOWNTIME)


def products(spark):
    from decimal import Decimal

    return spark.createDataFrame(
        [(1, "PAIN", "bread", "baked", 1, 90, 24.0, Decimal("0.45"), 180.0, 100),
         (2, "ECLAIR", "patisserie", "baked", 2, 360, 29.0, Decimal("1.20"), 360.0, 50)],
        schemas.DIM_PRODUCT,
    )


@pytest.fixture(scope="module")
def plant(spark):
    b = batches(spark, [
        batch("B1", 60.0, 48.0, 90, 10), batch("B2", 120.0, 90.0, 200, 0, 2, 2),
        batch("B3", 0.0, 0.0, 5, 1),
    ])
    s = stops(spark, [
        stop("D1", "B1", 8.0, 10.0, "01", "99"), stop("D2", "B1", 2.0, 2.0, "06", "06", False),
        stop("D3", "B1", 2.0, 2.0, "06", "06", False),
        stop("D4", "B2", 30.0, 30.0, "98", "99", True, 2),
    ])
    return b, s, products(spark), machine_table(spark)


def test_batch_oee(plant):
    rows = {r.batch_id: r for r in oee.batch_oee(plant[0], plant[2], plant[3], plant[1]).collect()}
    one = rows["B1"]
    assert (one.availability, one.quality) == (0.8, 0.9)
    assert one.performance == pytest.approx(100 / 180 / 0.8)
    assert one.oee == pytest.approx(one.availability * one.performance * one.quality)
    assert (one.logged_stop_hours, one.logged_stop_events) == (10 / 60, 1)
    assert one.scrap_cost_eur == 4.5
    # No planned time: ratios are NULL, and no stop means zero, not NULL.
    assert rows["B3"].availability is None and rows["B3"].oee is None
    assert (rows["B3"].logged_stop_hours, rows["B3"].logged_stop_events) == (0.0, 0)


def test_daily_oee_is_a_ratio_of_sums(spark, plant):
    b = batches(spark, [batch("B1", 60.0, 60.0, 100, 0), batch("B2", 600.0, 300.0, 100, 100)])
    daily = oee.oee_daily(oee.batch_oee(b, plant[2], plant[3], plant[1])).first()
    assert daily.availability == round(360 / 660, 4)
    assert daily.quality == round(200 / 300, 4)
    assert (daily.batches, daily.planned_hours) == (2, 11.0)


def test_unaccounted_time(plant):
    rows = {r.machine_id: r for r in downtime.unaccounted_time(
        oee.batch_oee(plant[0], plant[2], plant[3], plant[1])).collect()}
    assert rows[2].unaccounted_share == 0.0 and rows[2].availability_actual == 0.75
    assert rows[1].true_stop_hours == 0.2 and rows[1].availability_from_log == round(50 / 60, 4)


def test_reason_coding_keeps_codes_of_either_side(plant):
    rows = {r.reason_code: r for r in downtime.reason_coding(plant[1]).collect()}
    assert set(rows) == {"01", "06", "98", "99"}
    assert rows["99"].true_share is None and rows["99"].reported_share == 1.0
    assert rows["06"].reported_share is None and rows["06"].true_share == round(4 / 42, 4)
    assert rows["99"].share_distortion == 1.0
    assert rows["01"].share_distortion == -round(8 / 42, 4)


def test_equal_reasons_share_the_cumulative_value(spark, plant):
    s = stops(spark, [
        stop("D1", "B1", 5.0, 5.0, "02", "02"), stop("D2", "B1", 5.0, 5.0, "03", "03"),
        stop("D3", "B1", 10.0, 10.0, "04", "04"),
    ])
    got = {r.reason_code: r.cumulative_share
           for r in downtime.pareto_cumulative(s, plant[3]).collect()}
    assert got == {"04": 0.5, "02": 1.0, "03": 1.0}


def test_catchall_is_part_genuine(plant):
    rows = {r.true_reason_code: r.kind for r in downtime.catchall_split(plant[1]).collect()}
    assert rows == {"01": "miscoded", "98": "genuine"}


def violations(df):
    return {r.check_name: r.violations for r in df.collect()}


def inspections(spark, batch_ids):
    return spark.createDataFrame(
        [(f"I{b}", b, DAY, AT, 5, 0, "PASS", None) for b in batch_ids], schemas.FACT_INSPECTION
    )


def plant_demand(spark, day):
    return spark.createDataFrame([("PAIN", day, 1.0)], "product_name string, "
                                 "production_date date, units double")


def all_checks(spark, b, s, inspected, day=DAY):
    p, m = products(spark), machine_table(spark)
    views = kpi_views(b, s, p, m)
    return checks.identity_checks(views["v_batch_oee"], views["v_oee_daily"]).unionByName(
        checks.data_checks(b, s, inspections(spark, inspected), p, views["v_batch_oee"],
                           plant_demand(spark, day))
    ).unionByName(checks.contract_checks(s))


def test_every_check_passes_on_good_data(spark):
    b = batches(spark, [batch("B1", 60.0, 48.0, 90, 10), batch("B2", 120.0, 90.0, 200, 0, 2, 2)])
    s = stops(spark, [
        stop("D1", "B1", 10.0, 10.0, "01", "99"), stop("D2", "B1", 2.0, 2.0, "06", "06", False),
        stop("D3", "B2", 30.0, 30.0, "98", "99", True, 2),
    ])
    result = all_checks(spark, b, s, ["B1"])
    assert set(violations(result).values()) == {0}
    checks.require_passed(result)
    assert all(line.startswith("ok") for line in checks.report(result))


def test_every_check_fails_on_broken_data(spark):
    sunday = dt.date(2021, 1, 3)
    b = batches(spark, [
        batch("B1", 60.0, 70.0, 500, 10),            # run beyond plan, too fast
        batch("B2", 60.0, 30.0, 0, 5, 2, 1),         # no good unit, wrong machine
        batch("B3", 60.0, 60.0, 10, 0, 9, 1, sunday),  # unknown product, on a Sunday
        batch("B4", 0.0, 0.0, 1, 0),                 # NULL terms
    ])
    s = stops(spark, [
        stop("D1", "B9", 10.0, 10.0, "99", "99"), stop("D2", "B1", 900.0, 2.0, "06", "06"),
    ])
    got = violations(all_checks(spark, b, s, ["B1", "B8"], sunday))
    passed = {name for name, n in got.items() if n == 0}
    # The identity holds by construction, whatever the data.
    assert passed <= {"terms multiply to OEE at batch grain", "terms multiply to OEE by day"}
    assert got["no orphan stops"] == 1 and got["no orphan inspections"] == 1
    assert got["no orphan batches"] == 1 and got["batch machine matches the routing"] == 1
    with pytest.raises(checks.CheckFailure):
        checks.require_passed(all_checks(spark, b, s, ["B1"], sunday))


def test_machine_checks_fail_on_swapped_equipment(spark):
    m = machine_table(spark, [
        (1, "a", "deck_oven", 2012, "", "", 1.0, 0.01), (2, "b", "rack_oven", 2019, "", "", 2.0, 0.02),
    ])
    assert set(violations(checks.machine_checks(m)).values()) == {0, 1}
    assert violations(checks.machine_checks(m))["older oven fails more often"] == 1


def test_machine_hours_scale_with_the_factor(spark):
    demand = spark.createDataFrame(
        [("PAIN", DAY, 180.0), ("PAIN", dt.date(2021, 1, 5), 540.0)],
        "product_name string, sale_date date, units double",
    )
    got = {(r.machine_id, r.factor): r.hours_per_day
           for r in oee.machine_hours(demand, products(spark)).collect()}
    assert got == {(1, 1): 2.0, (1, 2): 4.0, (1, 3): 6.0, (1, 10): 20.0}
