"""Sales KPIs over lines of (ticket_number, product, quantity, unit_price, revenue, sale_date,
sale_ts).

Money is summed exactly (`money_sum`), whatever the partitioning.
Figures by weekday, month or trading day start from daily totals: one shuffle of
at most a row for each date and task, however many lines one date holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillfloor import params as P
from tillfloor.functions import (
    day_name,
    exact_round,
    global_ranks,
    line_count,
    money,
    money_round,
    money_sum,
    month_start,
    ratio,
    revenue_sum,
)
from tillfloor.functions.ordered import running_share
from tillfloor.session import stage
from tillfloor.sources.inline import weekday_table


def by_product(sales: DataFrame) -> DataFrame:
    return sales.groupBy("product").agg(
        F.sum("quantity").alias("units"),
        revenue_sum(sales).alias("revenue"),
        line_count(sales).alias("lines"),
    )


def by_day(sales: DataFrame) -> DataFrame:
    return sales.groupBy("sale_date").agg(
        F.sum("quantity").alias("units"), money_sum(F.col("revenue")).alias("revenue")
    )


def totals(sales: DataFrame) -> DataFrame:
    """Rows, distinct products, units and revenue, from the product totals."""
    return by_product(sales).agg(
        F.sum("lines").alias("total_rows"),
        F.count("product").alias("products"),
        F.sum("units").alias("total_units"),
        money_round(F.sum("revenue")).alias("total_revenue"),
    )


def product_performance(sales: DataFrame) -> DataFrame:
    return (
        by_product(sales)
        .select(
            "product",
            F.col("units").alias("total_units"),
            money_round(F.col("revenue")).alias("total_revenue"),
            F.col("lines").alias("times_sold"),
        )
        .orderBy(F.desc("total_revenue"), "product")
    )


def weekday_performance(sales: DataFrame) -> DataFrame:
    """Revenue per open day: the division follows the aggregation."""
    days = by_day(sales).withColumn("day_of_week", day_name(F.col("sale_date")))
    total, open_days = F.sum("revenue"), F.count("sale_date")
    return days.groupBy("day_of_week").agg(
        open_days.alias("days_open"),
        F.sum("units").alias("total_units"),
        money_round(total).alias("total_revenue"),
        exact_round(ratio(total, open_days), 2).alias("avg_revenue_per_open_day"),
    )


def monthly(sales: DataFrame) -> DataFrame:
    days = by_day(sales).withColumn("sale_month", month_start(F.col("sale_date")))
    return (
        days.groupBy("sale_month")
        .agg(
            F.sum("units").alias("total_units"),
            money_round(F.sum("revenue")).alias("total_revenue"),
        )
        .orderBy("sale_month")
    )


def hourly(sales: DataFrame) -> DataFrame:
    return (
        sales.groupBy(F.hour("sale_ts").alias("sale_hour"))
        .agg(
            F.sum("quantity").alias("total_units"),
            money_round(money_sum(F.col("revenue"))).alias("total_revenue"),
        )
        .orderBy("sale_hour")
    )


def ticket_averages(sales: DataFrame) -> DataFrame:
    """Lines are summed to tickets, then the tickets are averaged."""
    tickets = (
        sales.where(F.col("ticket_number").isNotNull())
        .groupBy("ticket_number")
        .agg(F.sum("quantity").alias("items"), F.sum("revenue").alias("amount"))
        .withColumn("amount", money(F.col("amount")))
    )
    n = F.count("*")
    return tickets.agg(
        n.alias("tickets"),
        exact_round(ratio(F.sum("items"), n), 2).alias("avg_items"),
        exact_round(ratio(money_sum(F.col("amount")), n), 2).alias("avg_value"),
    )


def top_products(sales: DataFrame, measure: str, rows: int = 10) -> DataFrame:
    """The best products by units or by revenue; equal ones in name order."""
    amount = F.col("units") if measure == "units" else money_round(F.col("revenue"))
    ranked = by_product(sales.where(F.col("product").isNotNull())).orderBy(
        F.desc(measure), "product"
    )
    return ranked.limit(rows).select("product", amount.alias(f"total_{measure}"))


def rank_units_and_revenue(sales: DataFrame) -> DataFrame:
    """Every product's rank by units beside its rank by revenue."""
    totals_ = stage(by_product(sales).select("product", "units", "revenue"))
    ranked = global_ranks(totals_, {"units_rank": "units", "revenue_rank": "revenue"})
    return ranked.select(
        "product",
        "units",
        money_round(F.col("revenue")).alias("revenue"),
        "units_rank",
        "revenue_rank",
        (F.col("units_rank") - F.col("revenue_rank")).alias("rank_gap"),
    )


def weekday_revenue(sales: DataFrame) -> DataFrame:
    """Revenue from Monday to Sunday; a weekday without sales has NULL."""
    days = by_day(sales).withColumn("day_of_week", day_name(F.col("sale_date")))
    revenue = days.groupBy("day_of_week").agg(
        money_round(F.sum("revenue")).alias("total_revenue")
    )
    return weekday_table(sales.sparkSession).join(revenue, "day_of_week", "left").select(
        "weekday_no", "day_of_week", "total_revenue"
    )


def weekday_presence(sales: DataFrame) -> DataFrame:
    """Number of trading dates of each weekday, in calendar order."""
    dates = sales.select("sale_date").where(F.col("sale_date").isNotNull()).distinct()
    counted = dates.groupBy(day_name(F.col("sale_date")).alias("day_of_week")).agg(
        F.count("*").alias("days_present")
    )
    return weekday_table(sales.sparkSession).join(counted, "day_of_week", "left").select(
        "weekday_no", "day_of_week", "days_present"
    )


def top_months(sales: DataFrame, rows: int = 6) -> DataFrame:
    months = (
        sales.where(F.col("sale_date").isNotNull())
        .groupBy(month_start(F.col("sale_date")).alias("sale_month"))
        .agg(money_sum(F.col("revenue")).alias("revenue"))
    )
    return months.orderBy(F.desc("revenue"), "sale_month").limit(rows).select(
        "sale_month", money_round(F.col("revenue")).alias("total_revenue")
    )


def top_hours(sales: DataFrame, rows: int = 6) -> DataFrame:
    hours = (
        sales.where(F.col("sale_ts").isNotNull())
        .groupBy(F.hour("sale_ts").alias("sale_hour"))
        .agg(F.sum("quantity").alias("total_units"))
    )
    return hours.orderBy(F.desc("total_units"), "sale_hour").limit(rows)


def month_open_day_average(sales: DataFrame, rows: int = 6) -> DataFrame:
    """Months by revenue per trading day, a fair comparison of unequal months."""
    days = by_day(sales.where(F.col("sale_date").isNotNull()))
    months = days.groupBy(month_start(F.col("sale_date")).alias("sale_month")).agg(
        F.sum("revenue").alias("revenue"), F.count("*").alias("days")
    )
    average = ratio(F.col("revenue"), F.col("days"))
    return (
        months.withColumn("average", average)
        .orderBy(F.desc("average"), "sale_month")
        .limit(rows)
        .select(
            "sale_month",
            money_round(F.col("revenue")).alias("total_revenue"),
            "days",
            exact_round(F.col("average"), 2).alias("avg_per_day"),
        )
    )


def monthly_trend(sales: DataFrame, summer: tuple[int, ...] = P.PARAMS.summer_months) -> DataFrame:
    days = by_day(sales.where(F.col("sale_date").isNotNull()))
    return (
        days.groupBy(month_start(F.col("sale_date")).alias("sale_month"))
        .agg(money_round(F.sum("revenue")).alias("total_revenue"))
        .withColumn("is_summer", F.month("sale_month").isin(*summer))
    )


def product_shares(sales: DataFrame) -> DataFrame:
    """Share of units and revenue of each product, and the concentration of units.

    `cumulative_unit_share` is the share of the products that sell at least as much.
    """
    totals_ = stage(by_product(sales).select("product", "units", "revenue"))
    all_units = totals_.select(F.sum("units").alias("t")).scalar()
    all_revenue = totals_.select(F.sum("revenue").cast("double").alias("t")).scalar()
    shares = running_share(totals_, "units", "cumulative_unit_share", 4)
    return shares.select(
        "product",
        "units",
        money_round(F.col("revenue")).alias("revenue"),
        exact_round(ratio(F.col("units"), all_units), 4).alias("unit_share"),
        exact_round(ratio(F.col("revenue"), all_revenue), 4).alias("revenue_share"),
        "cumulative_unit_share",
    )


def morning_share(
    sales: DataFrame, hours: tuple[int, int] = P.PARAMS.morning_hours
) -> DataFrame:
    """Units sold in the morning hours [first, last) against the rest of the day."""
    hour = F.hour("sale_ts")
    morning = F.sum(F.when((hour >= hours[0]) & (hour < hours[1]), F.col("quantity")))
    units = F.sum("quantity")
    morning = F.coalesce(morning, F.lit(0.0))
    return sales.agg(
        morning.alias("morning_units"),
        (units - morning).alias("other_units"),
        exact_round(ratio(morning, units), 4).alias("morning_share"),
    )


def weekend_ratio(
    sales: DataFrame, genuine_share: float = P.PARAMS.genuine_day_share
) -> DataFrame:
    """Best weekday over the lowest genuine trading weekday.

    A weekday that is mostly closed looks weak for its calendar, not its demand,
    so only weekdays with enough trading dates compete for the lowest place.
    """
    days = by_day(sales.where(F.col("sale_date").isNotNull())).withColumn(
        "day_of_week", day_name(F.col("sale_date"))
    )
    week = days.groupBy("day_of_week").agg(
        F.count("*").alias("dates"), F.sum("revenue").alias("revenue")
    )
    # Seven rows at most, so one array holds the week.
    entry = F.struct("revenue", "day_of_week", "dates")
    one = week.agg(
        F.array_sort(F.collect_list(entry)).alias("week"), F.max("dates").alias("most")
    )
    genuine = F.filter("week", lambda d: d["dates"] >= F.col("most") * genuine_share)
    best, low = F.element_at("week", -1), F.element_at(genuine, 1)
    return one.select(best.alias("best"), low.alias("low")).select(
        F.col("best.day_of_week").alias("best_day"),
        money_round(F.col("best.revenue")).alias("best_revenue"),
        F.col("low.day_of_week").alias("lowest_day"),
        money_round(F.col("low.revenue")).alias("lowest_revenue"),
        exact_round(ratio(F.col("best.revenue"), F.col("low.revenue")), 4).alias("ratio"),
    )


def dashboard_daily(sales: DataFrame) -> DataFrame:
    """Compact feed: one row for each date and product. Date parts follow the group."""
    grouped = (
        sales.where(F.col("product").isNotNull() & F.col("sale_date").isNotNull())
        .groupBy("sale_date", "product")
        .agg(F.sum("quantity").alias("units"), money_sum(F.col("revenue")).alias("revenue"))
    )
    return grouped.select(
        "sale_date",
        day_name(F.col("sale_date")).alias("day_of_week"),
        month_start(F.col("sale_date")).alias("sale_month"),
        "product",
        "units",
        money_round(F.col("revenue")).alias("revenue"),
    )


def daily_demand(sales: DataFrame, product_names: DataFrame) -> DataFrame:
    """Units by product and date for the products of the dimension.

    `product_names` has one row for each kept product, at most the top-product
    cut: Spark broadcasts it by its size, and lines of other products never
    reach the shuffle.
    """
    kept = product_names.select(F.col("product_name").alias("product"))
    return (
        sales.where(F.col("quantity") > 0)
        .join(kept, "product", "left_semi")
        .groupBy(F.col("product").alias("product_name"), "sale_date")
        .agg(F.sum("quantity").alias("units"))
    )


def trading_days(demand: DataFrame) -> DataFrame:
    return demand.select("sale_date").distinct().agg(F.count("sale_date").alias("trading_days"))
