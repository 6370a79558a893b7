from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillfloor.functions import batch_key
from tillfloor.operators import planning

DAY = dt.date(2021, 1, 4)


def routed(spark, load=90, kind="baked", machine_type="deck_oven", names=("A",)):
    return spark.createDataFrame(
        [(i + 1, n, "bread", kind, 1, machine_type, load, 24.0, 180.0)
         for i, n in enumerate(names)],
        "product_id int, product_name string, product_category string, process_type string, "
        "machine_id int, machine_type string, units_per_full_load int, bake_minutes double, "
        "ideal_units_per_hr double",
    )


def demand(spark, units, name="A"):
    return spark.createDataFrame(
        [(name, DAY + dt.timedelta(days=i), float(u)) for i, u in enumerate(units)],
        "product_name string, production_date date, units double",
    )


def released(spark, units, **kw):
    lots = planning.min_lot_carry(demand(spark, units), routed(spark, **kw)).collect()
    by_day = {(r.production_date - DAY).days: r.units for r in lots}
    return [by_day.get(i, 0) for i in range(len(units))]


def walk(units, minimum):
    carry, out = 0.0, []
    for u in units:
        u += carry
        carry, lot = (0.0, u) if u >= minimum and round(u) >= 1 else (u, 0)
        out.append(lot)
    return out


def test_carry_until_the_minimum_lot(spark):
    # A load of 15 on the deck oven makes a minimum of 5.
    assert released(spark, [3, 4, 9, 1, 2, 8], load=15) == [0, 7, 9, 0, 0, 11]


def test_rest_at_the_end_is_not_released(spark):
    assert released(spark, [6, 2, 2], load=15) == [6, 0, 0]


def test_assembled_items_have_no_minimum(spark):
    assert released(spark, [1, 2], load=None, kind="assembled") == [1, 2]


def test_rack_lot_is_an_eighteenth(spark):
    assert released(spark, [15, 1], load=288, machine_type="rack_oven") == [0, 16]


@pytest.mark.parametrize("load", [3, 30, 120, 3000])
def test_carry_against_a_plain_walk(spark, load):
    units = [(i * 37) % 23 for i in range(1, 400)]
    assert released(spark, units, load=load) == walk(units, load / 3)


def test_sunday_is_baked_on_saturday(spark):
    sun = dt.date(2021, 1, 3)
    df = spark.createDataFrame(
        [("A", sun, 5.0), ("A", sun - dt.timedelta(days=1), 2.0)],
        "product_name string, sale_date date, units double",
    )
    rows = planning.plant_demand(df, 2).collect()
    assert [(r.production_date, r.units) for r in rows] == [(dt.date(2021, 1, 2), 14.0)]


def test_equal_lots_run_in_name_order_and_share_a_clock(spark):
    plants = demand(spark, [90], "B").union(demand(spark, [90], "A")).union(
        demand(spark, [120], "C")
    )
    r = routed(spark, names=("A", "B", "C"))
    plan = planning.dispatch_order(planning.batch_plan(planning.min_lot_carry(plants, r), r))
    rows = planning.changeovers(planning.machine_schedule(plan)).orderBy("seq").collect()
    assert [x.product_name for x in rows] == ["C", "A", "B"]
    assert [x.changeover for x in rows] == [0, 1, 1]
    assert rows[0].scheduled_start_ts == dt.datetime(2021, 1, 4, 2, 0)
    assert rows[1].scheduled_start_ts == rows[0].scheduled_end_ts
    # 120 units at 180 an hour and 85 % efficiency.
    assert rows[0].planned_minutes == pytest.approx(120 / 180 * 60 / 0.85)


def test_batch_key_is_the_md5_of_its_parts(spark):
    import hashlib

    want = "B" + hashlib.md5(b"20210104-7-2").hexdigest()[:12]
    df = spark.createDataFrame([(DAY, 7, 2)], "d date, p int, s int")
    assert df.select(batch_key(F.col("d"), F.col("p"), F.col("s"))).first()[0] == want
    assert df.select(planning.stop_key(F.lit(want), F.lit(3))).first()[0] == f"D{want[1:]}-3"


STOP = "downtime_id string, batch_id string, start_ts timestamp_ntz, duration_minutes double"


def test_stops_are_laid_end_to_end_and_capped(spark):
    at = dt.datetime(2021, 1, 4, 2)
    stops = spark.createDataFrame(
        [("D1", "B1", at, 10.0), ("D2", "B1", at + dt.timedelta(hours=3), 20.0),
         ("D3", "B1", at + dt.timedelta(hours=1), 70.0), ("D4", "B2", at, 5.0)], STOP
    )
    batches = spark.createDataFrame(
        [("B1", 100.0, at), ("B2", 100.0, at)],
        "batch_id string, planned_production_minutes double, actual_start_ts timestamp_ntz",
    )
    laid = {r.downtime_id: r for r in planning.stop_intervals(
        stops, batches, minutes="duration_minutes").collect()}
    assert laid["D1"].laid_start_ts == at
    assert laid["D3"].laid_start_ts == at + dt.timedelta(minutes=10)
    assert laid["D2"].laid_start_ts == at + dt.timedelta(minutes=80)
    capped = {r.downtime_id: r.capped_minutes
              for r in planning.stop_cap(stops, batches).collect()}
    assert sum(capped[d] for d in ("D1", "D2", "D3")) == pytest.approx(85.0)
    assert capped["D4"] == 5.0


def capped_batch(spark):
    """Planned 20 minutes: ten stops of 4 lose 17 minutes at most, 1.7 each, none of them long."""
    at = dt.datetime(2021, 1, 4, 2)
    stops = spark.createDataFrame(
        [(f"D{i}", "B1", at + dt.timedelta(minutes=i), 4.0) for i in range(10)]
        + [("D90", "B2", at, 4.0), ("D91", "B3", at, 50.0)], STOP
    )
    batches = spark.createDataFrame(
        [("B1", 20.0, at, 1, 100, 0.02), ("B2", 20.0, at, 1, 100, 0.02), ("B3", 1.0, at, 1, 1, 0.0)],
        "batch_id string, planned_production_minutes double, actual_start_ts timestamp_ntz, "
        "product_id int, total_units int, base_rate double",
    )
    products = spark.createDataFrame(
        [(1, "bread", 60.0)], "product_id int, product_category string, ideal_units_per_hr double"
    )
    return stops, batches, products


def test_long_stops_are_counted_after_the_cap(spark):
    stops, batches, products = capped_batch(spark)
    capped = planning.stop_cap(stops, batches)
    got = {r.batch_id: r for r in planning.scrap_with_stops(batches, capped, products).collect()}
    assert (got["B1"].long_stops, got["B1"].scrap_rate) == (0, 0.02)
    assert (got["B2"].long_stops, got["B2"].scrap_rate) == (1, 0.032)


def test_no_laid_stop_ends_after_its_batch(spark):
    stops, batches, products = capped_batch(spark)
    laid = planning.stop_intervals(planning.stop_cap(stops, batches), batches).collect()
    end = {"B1": 20, "B2": 20, "B3": 1}
    start = dt.datetime(2021, 1, 4, 2)
    total: dict[str, float] = {}
    for r in laid:
        assert r.laid_end_ts <= start + dt.timedelta(minutes=end[r.batch_id])
        total[r.batch_id] = total.get(r.batch_id, 0) + (r.laid_end_ts - r.laid_start_ts).total_seconds() / 60
    run = {r.batch_id: r for r in planning.run_time(batches.drop("total_units"), stops, products).collect()}
    for b in ("B1", "B2"):
        assert total[b] == pytest.approx(20 - run[b].run_minutes, abs=1e-3)


def test_a_batch_without_output_goes_with_what_belongs_to_it(spark):
    stops, batches, products = capped_batch(spark)
    left = planning.run_time(batches.drop("total_units"), stops, products)
    assert {r.batch_id for r in left.collect()} == {"B1", "B2"}
    assert {r.batch_id for r in planning.of_batches(stops, left).collect()} == {"B1", "B2"}


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_a_batch_with_a_third_of_all_stops(spark, threshold):
    at = dt.datetime(2021, 1, 4, 2)
    rows = [
        (f"D{i:05d}", "B0" if i % 3 == 0 else f"B{i % 50}", at + dt.timedelta(minutes=i * 7 % 9000),
         float(i % 11 + 1)) for i in range(3000)
    ]
    stops = spark.createDataFrame(rows, STOP).repartition(8)
    batches = spark.createDataFrame(
        [(f"B{i}", 100.0 * (i + 1), at) for i in range(50)],
        "batch_id string, planned_production_minutes double, actual_start_ts timestamp_ntz",
    )
    totals: dict[str, float] = {}
    want_start, want_capped = {}, {}
    for key, b, _, minutes in sorted(rows, key=lambda r: (r[2], r[0])):
        want_start[key] = at + dt.timedelta(minutes=totals.get(b, 0.0))
        totals[b] = totals.get(b, 0.0) + minutes
    for key, b, _, minutes in rows:
        cap = 0.85 * 100.0 * (int(b[1:]) + 1)
        want_capped[key] = minutes * min(1.0, cap / totals[b])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        laid = planning.stop_intervals(stops, batches, minutes="duration_minutes").collect()
        capped = planning.stop_cap(stops, batches).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r.downtime_id: r.laid_start_ts for r in laid} == want_start
    assert {r.downtime_id: r.capped_minutes for r in capped} == pytest.approx(want_capped)


def test_rounded_minutes_half_to_even_with_a_floor(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 7.5, 12.5, 11.97)], "m double")
    got = [r[0] for r in df.select(planning.rounded_minutes(F.col("m"))).collect()]
    assert got == [5.0, 10.0, 10.0, 10.0]


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(4000).select(
        F.concat(F.lit("B"), "id").alias("batch_id"), F.lit(DAY).alias("production_date"),
        F.lit(None).cast("timestamp_ntz").alias("actual_end_ts"),
        F.lit(90).alias("good_units"), F.lit(10).alias("scrap_units"),
    )
    one = {r.batch_id for r in planning.inspection_sample(df.coalesce(1)).collect()}
    many = {r.batch_id for r in planning.inspection_sample(df.repartition(7)).collect()}
    assert one == many and 900 < len(one) < 1100
    row = planning.inspection_sample(df).first()
    assert (row.sample_size, row.outcome) == (5, "FAIL")
