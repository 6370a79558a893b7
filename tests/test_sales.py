from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillfloor import params as P
from tillfloor.functions import money_sum
from tillfloor.operators import checks, product, sales
from tillfloor.sources.inline import machine_table, standards_table

LINE = (
    "ticket_number bigint, product string, quantity double, unit_price double, "
    "revenue double, sale_date date, sale_ts timestamp_ntz"
)


def lines(spark, rows):
    data = [
        (t, p, q, price, round(q * price, 4), d, dt.datetime.combine(d, dt.time(h)))
        for t, p, q, price, d, h in rows
    ]
    return spark.createDataFrame(data, LINE)


MON, TUE, SUN = dt.date(2021, 1, 4), dt.date(2021, 1, 5), dt.date(2021, 1, 3)


@pytest.fixture(scope="module")
def small(spark):
    return lines(spark, [
        (1, "PAIN", 2.0, 1.5, MON, 8), (1, "ECLAIR", 1.0, 4.0, MON, 8),
        (2, "PAIN", 1.0, 1.5, TUE, 12), (3, "PAIN", 4.0, 1.5, SUN, 11),
    ])


def test_money_sum_is_exact(spark):
    df = spark.range(100_000).select((F.col("id") * 0 + 0.1).alias("x"))
    assert df.agg(money_sum(F.col("x"))).first()[0] == Decimal("10000.0000")
    mixed = spark.createDataFrame([(-1.25,), (3.0001,), (None,)], "x double")
    assert mixed.agg(money_sum(F.col("x"))).first()[0] == Decimal("1.7501")
    big = spark.createDataFrame([(9e10,)] * 1000, "x double")
    assert big.agg(money_sum(F.col("x"))).first()[0] == Decimal("90000000000000")


def test_weekday_without_sales_is_null(small):
    week = {r.day_of_week: r.total_revenue for r in sales.weekday_revenue(small).collect()}
    assert list(sorted(week)) == sorted(P.WEEKDAYS)
    assert week["Wednesday"] is None and week["Monday"] == 7.0


def test_ticket_averages(small):
    assert tuple(sales.ticket_averages(small).first()) == (3, 2.67, 4.83)


def test_morning_is_eight_to_noon(small):
    row = sales.morning_share(small).first()
    assert (row.morning_units, row.other_units) == (7.0, 1.0)


def test_mostly_closed_weekday_is_not_the_lowest(spark):
    days = [dt.date(2021, 1, 4) + dt.timedelta(days=i) for i in range(21)]
    open_days = [d for d in days if d.weekday() != 2] + [days[2]]
    df = lines(spark, [
        (i, "PAIN", 1.0 + d.weekday(), 1.0, d, 9) for i, d in enumerate(open_days)
    ])
    row = sales.weekend_ratio(df).first()
    assert (row.best_day, row.lowest_day, row.ratio) == ("Sunday", "Monday", 7.0)


def test_golden_totals_check(small):
    totals = sales.totals(small)
    right = {"total_rows": 4, "products": 2, "total_revenue": 14.5}
    checks.require_passed(checks.total_checks(totals, right))
    with pytest.raises(checks.CheckFailure, match="products as expected"):
        checks.require_passed(checks.total_checks(totals, {**right, "products": 147}))


def test_dim_product_of_the_real_names(spark):
    names = [s[0] for s in P.OPERATING_STANDARDS] + list(P.EXCLUDED_PRODUCTS)
    df = lines(spark, [
        (i, n, float(100 - i), 2.0, MON, 8) for i, n in enumerate(names)
    ] + [(99, "PAIN AU LEVAIN", 1.0, 9.0, MON, 8)])
    dim = product.dim_product(df, standards_table(spark), machine_table(spark))
    by_name = {r.product_name: r for r in dim.collect()}
    assert len(by_name) == 27 and by_name["TRADITIONAL BAGUETTE"].product_id == 1
    # Published rates: 30 and 20 minute cycles.
    assert by_name["BAGUETTE"].ideal_units_per_hr == 180.00
    assert by_name["CROISSANT"].ideal_units_per_hr == 864.00
    assert by_name["SANDWICH COMPLET"].ideal_units_per_hr == 60.00
    assert by_name["SANDWICH COMPLET"].unit_cost_eur == Decimal("0.90")
    assert by_name["KOUIGN AMANN"].product_category == "viennoiserie"
    checks.require_passed(checks.dimension_checks(dim, machine_table(spark)))


def test_products_without_standards_keep_nulls(spark):
    df = lines(spark, [(1, "BAGUETTE", 5.0, 1.0, MON, 8), (2, "UNKNOWN", 4.0, 1.0, MON, 8)])
    dim = product.dim_product(df, standards_table(spark), machine_table(spark))
    unknown = dim.where("product_name = 'UNKNOWN'").first()
    assert unknown.machine_id is None and unknown.unit_cost_eur is None
    failed = {
        r.check_name: r.violations
        for r in checks.dimension_checks(dim, machine_table(spark)).collect() if r.violations
    }
    assert failed["product count"] == 25 and failed["standards present"] == 1


def test_median_is_over_lines_not_units(spark):
    df = lines(spark, [
        (1, "PAIN", 100.0, 9.0, MON, 8), (2, "PAIN", 1.0, 1.0, MON, 8),
        (3, "PAIN", 1.0, 2.0, MON, 8), (4, "PAIN", 1.0, 4.0, MON, 8),
    ])
    row = product.median_prices(product.price_counts(df)).first()
    assert row.median_unit_price_eur == 3.0


def test_units_beyond_32_bits(spark):
    from tillfloor import params as P
    from tillfloor.operators import product
    from tillfloor.sources.inline import machine_table, standards_table

    names = [s[0] for s in P.OPERATING_STANDARDS]
    lines = spark.createDataFrame(
        [(n, 1.2, 3.0e9 - i, 1) for i, n in enumerate(names)],
        "product string, unit_price double, quantity double, lines bigint",
    )
    dim = product.dim_product(lines, standards_table(spark), machine_table(spark))
    assert max(r.v1_total_units for r in dim.collect()) == 3_000_000_000
