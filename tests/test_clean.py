from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tillfloor.operators import clean, profile

RAW = "date string, time string, ticket_number double, article string, Quantity double, unit_price string"


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW)


def line(price, quantity=1.0, name="PAIN", ticket=150040.0):
    return ("2021-01-02", "08:38", ticket, name, quantity, price)


def test_price_text(spark):
    df = raw(spark, [line("0,90 €"), line("12,00 €"), line(" 1,5€ "), line(None)])
    prices = [r.unit_price for r in clean.typed_lines(df).collect()]
    assert prices == [0.90, 12.0, 1.5, None]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_bad_price_fails(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="not a double"):
            clean.typed_lines(raw(spark, [line("free")])).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_typed_columns(spark):
    df = raw(spark, [line("0,90 €")]).withColumn("Unnamed: 0", F.lit(0))
    row = clean.typed_lines(df).first()
    assert row.ticket_number == 150040
    assert str(row.datetime) == "2021-01-02 08:38:00"
    assert "Unnamed: 0" not in row.asDict()


def test_funnel_counts_a_returned_free_item_as_a_return(spark):
    df = raw(spark, [
        line("0,90 €"), line("0,90 €", -1.0), line("0,00 €"), line("0,00 €", -2.0),
    ])
    row = clean.clean_funnel(df).first()
    assert tuple(row) == (4, 2, 1, 1)
    assert [r.revenue for r in clean.clean_sales(df).collect()] == [0.9]


def test_catchall_is_left_out(spark):
    df = raw(spark, [line("1,00 €", name="DIVERS PATISSERIE"), line("1,00 €", name="PAIN")])
    base = clean.sales_base(clean.clean_sales(df))
    assert [r["product"] for r in clean.without_catchall(base).collect()] == ["PAIN"]


def test_duplicates_treat_nulls_as_equal(spark):
    df = raw(spark, [line(None), line(None), line(None), line("1,00 €")])
    assert profile.duplicates(df).first()[0] == 2


def test_nulls_by_column(spark):
    df = raw(spark, [line(None), line("1,00 €")])
    assert {r.column_name: r.nulls for r in profile.nulls(df).collect()}["unit_price"] == 1


def test_shape_peek_and_types(spark):
    df = raw(spark, [line("1,00 €")] * 3)
    assert tuple(profile.shape(df).first()) == (3, 6)
    assert profile.peek(df, 2).count() == 2
    assert profile.column_types(df)[0] == ("date", "string")


def test_describe_of_an_empty_column(spark):
    df = spark.createDataFrame([(None,)], "x double")
    row = profile.describe(df, "x").first()
    assert row["count"] == 0 and row["q50"] is None and row["std"] is None
