"""Cleaning of till lines: parse text, drop returns and free items, add revenue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillfloor import params as P
from tillfloor.functions import day_name, money, month_start


def _strict(text: Column, kind: str) -> Column:
    """NULL stays NULL; text that does not convert fails the job, in any ANSI mode."""
    value = text.try_cast(kind)
    error = F.raise_error(F.concat(F.lit(f"not a {kind}: "), text))
    return F.when(text.isNotNull() & value.isNull(), error).otherwise(value)


def parse_price(text: Column) -> Column:
    """'0,90 €' to 0.90."""
    plain = F.replace(F.replace(text, F.lit("€"), F.lit("")), F.lit(","), F.lit("."))
    return _strict(F.trim(plain), "double")


def join_timestamp(date: Column, time: Column) -> Column:
    return _strict(F.concat(date, F.lit(" "), time), "timestamp_ntz")


def typed_lines(raw: DataFrame) -> DataFrame:
    """Typed columns, before any row is removed; the junk index column is dropped."""
    return raw.drop("Unnamed: 0").select(
        "date",
        "time",
        join_timestamp(F.col("date"), F.col("time")).alias("datetime"),
        F.col("ticket_number").cast("bigint").alias("ticket_number"),
        "article",
        "Quantity",
        parse_price(F.col("unit_price")).alias("unit_price"),
    )


def clean_sales(raw: DataFrame) -> DataFrame:
    """Sold lines with a price: quantity > 0, then price > 0, then the revenue."""
    return (
        typed_lines(raw)
        .where(F.col("Quantity") > 0)
        .where(F.col("unit_price") > 0)
        .withColumn("revenue", money(F.col("Quantity") * F.col("unit_price")))
    )


def clean_funnel(raw: DataFrame) -> DataFrame:
    """Rows removed by each step in order; a returned free item counts as a return.

    Only quantity and price decide, so a `raw` without dates will do.
    """
    rows = raw.select("Quantity", parse_price(F.col("unit_price")).alias("unit_price"))
    sold = F.col("Quantity") > 0
    priced = F.col("unit_price") > 0
    return rows.agg(
        F.count("*").alias("raw_rows"),
        (F.count("*") - F.count_if(sold)).alias("returns_removed"),
        (F.count_if(sold) - F.count_if(sold & priced)).alias("zero_price_removed"),
        F.count_if(sold & priced).alias("clean_rows"),
    )


def price_text(raw: DataFrame) -> DataFrame:
    """Ticket, article and the price as a number."""
    return raw.select(
        F.col("ticket_number").cast("bigint").alias("ticket_number"),
        "article",
        parse_price(F.col("unit_price")).alias("unit_price"),
    )


def sales_base(clean: DataFrame) -> DataFrame:
    """Friendly names and the date parts that the KPIs group by."""
    date = F.to_date("datetime")
    return clean.select(
        "ticket_number",
        F.col("article").alias("product"),
        F.col("Quantity").alias("quantity"),
        "unit_price",
        "revenue",
        "datetime",
        date.alias("sale_date"),
        F.hour("datetime").alias("sale_hour"),
        day_name(date).alias("day_of_week"),
        month_start(date).alias("sale_month"),
    )


def without_catchall(
    df: DataFrame, name: str = "product", prefix: str = P.CATCHALL_PREFIX
) -> DataFrame:
    """Leave out register categories that are no single product."""
    return df.where(~F.col(name).startswith(prefix))
