"""OEE on a time basis: output becomes earned hours, ratios are ratios of sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillfloor.functions import (
    exact_round,
    global_ranks,
    hours_sum,
    minutes_sum,
    money,
    money_round,
    money_sum,
    ratio,
)
from tillfloor.session import stage


def logged_stops(stops: DataFrame) -> DataFrame:
    """What the operator log holds for each batch: reported minutes and stops."""
    return (
        stops.where("was_logged")
        .groupBy("batch_id")
        .agg(
            exact_round(minutes_sum(F.col("reported_duration_minutes")), 6).alias("logged_stop_minutes"),
            F.count("*").alias("logged_stop_events"),
        )
    )


TERMS = ("availability", "performance", "quality", "oee")


def terms() -> dict[str, Column]:
    """The OEE terms of a batch joined to its product's rate."""
    good, total = F.col("good_units"), F.col("good_units") + F.col("scrap_units")
    planned, run = F.col("planned_production_minutes") / 60.0, F.col("run_time_minutes") / 60.0
    rate = F.col("ideal_units_per_hr")
    return {
        "availability": ratio(F.col("run_time_minutes"), F.col("planned_production_minutes")),
        "performance": ratio(ratio(total, rate), run),
        "quality": ratio(good, total),
        "oee": ratio(ratio(good, rate), planned),
    }


def batch_oee(
    batches: DataFrame, products: DataFrame, machines: DataFrame, stops: DataFrame
) -> DataFrame:
    """One row for each batch: hours, earned hours and the OEE terms.

    Stops are summed to batches before the join, so it is one to one and a batch
    with very many stops is combined map-side. The product table may be large:
    its join follows the join by batch, so that its shuffle is its own and can
    be split where one product has a large part of all batches.
    """
    good, scrap = F.col("good_units"), F.col("scrap_units")
    total = good + scrap
    rate = F.col("ideal_units_per_hr")
    planned = F.col("planned_production_minutes") / 60.0
    run = F.col("run_time_minutes") / 60.0
    earned, good_earned = ratio(total, rate), ratio(good, rate)
    attributes = products.select(
        "product_id", "product_name", "product_category", "unit_cost_eur", "ideal_units_per_hr"
    )
    joined = (
        batches.join(logged_stops(stops), "batch_id", "left")
        .join(attributes, "product_id")
        .join(machines.select("machine_id", "machine_name"), "machine_id")
    )
    return joined.select(
        "batch_id",
        "production_date",
        "product_id",
        "product_name",
        "product_category",
        "machine_id",
        "machine_name",
        "planned_units",
        "good_units",
        "scrap_units",
        total.alias("total_units"),
        planned.alias("planned_hours"),
        run.alias("run_hours"),
        (F.coalesce(F.col("logged_stop_minutes"), F.lit(0.0)) / 60.0).alias("logged_stop_hours"),
        F.coalesce(F.col("logged_stop_events"), F.lit(0)).alias("logged_stop_events"),
        earned.alias("earned_hours"),
        good_earned.alias("good_earned_hours"),
        *[term.alias(name) for name, term in terms().items()],
        money(scrap * F.col("unit_cost_eur").cast("double")).alias("scrap_cost_eur"),
    )


def clock_hours(hours: str) -> Column:
    """Total of hours that are minutes of two decimals: the minutes are summed."""
    return minutes_sum(F.round(F.col(hours) * 60, 4)).cast("double") / 60


def _sum_ratio(numerator: Column, denominator: Column) -> Column:
    return exact_round(ratio(numerator, denominator), 4)


def oee_daily(oee: DataFrame, *more: Column) -> DataFrame:
    """By date and machine, with further aggregates where a caller asks for them. Unrounded sums are divided; rounding comes last."""
    planned, run = clock_hours("planned_hours"), clock_hours("run_hours")
    earned, good = hours_sum(F.col("earned_hours")), hours_sum(F.col("good_earned_hours"))
    return oee.groupBy("production_date", "machine_id", "machine_name").agg(
        F.count("*").alias("batches"),
        F.sum("total_units").alias("total_units"),
        F.sum("good_units").alias("good_units"),
        F.sum("scrap_units").alias("scrap_units"),
        money_round(money_sum(F.col("scrap_cost_eur"))).alias("scrap_cost_eur"),
        exact_round(planned, 2).alias("planned_hours"),
        exact_round(run, 2).alias("run_hours"),
        exact_round(clock_hours("logged_stop_hours"), 2).alias("logged_stop_hours"),
        _sum_ratio(run, planned).alias("availability"),
        _sum_ratio(earned, run).alias("performance"),
        _sum_ratio(good, earned).alias("quality"),
        _sum_ratio(good, planned).alias("oee"),
        *more,
    )


def mean_daily_oee(batch: DataFrame, sampled: Column, stops: DataFrame) -> DataFrame:
    """Mean of the daily OEE beside the row counts of the facts.

    One pass over the batches: they and those that are `sampled` for inspection are counted by day.
    """
    daily = oee_daily(batch, F.count_if(sampled).alias("inspections"))
    return daily.agg(
        F.coalesce(F.sum("batches"), F.lit(0)).alias("batches"),
        F.coalesce(F.sum("inspections"), F.lit(0)).alias("inspections"),
        exact_round(F.avg("oee"), 4).alias("mean_daily_oee"),
    ).select(
        "batches",
        stops.agg(F.count("*").alias("n")).scalar().alias("downtime_events"),
        "inspections",
        "mean_daily_oee",
    )


def scrap_by_product(oee: DataFrame) -> DataFrame:
    cost = money_sum(F.col("scrap_cost_eur"))
    total, scrap = F.sum("total_units"), F.sum("scrap_units")
    return oee.groupBy("product_id", "product_name", "product_category", "machine_name").agg(
        F.count("*").alias("batches"),
        total.alias("total_units"),
        scrap.alias("scrap_units"),
        exact_round(ratio(scrap, total), 4).alias("scrap_rate"),
        money_round(cost).alias("scrap_cost_eur"),
        exact_round(ratio(cost, total), 4).alias("scrap_cost_per_unit"),
    )


def scrap_rank_gap(oee: DataFrame) -> DataFrame:
    """Rank by scrap rate beside rank by scrap cost: they differ."""
    scrap, total = F.sum("scrap_units"), F.sum("total_units")
    products = stage(
        oee.groupBy("product_name").agg(
            exact_round(ratio(scrap, total), 8).alias("scrap_rate"),
            money_round(money_sum(F.col("scrap_cost_eur"))).alias("scrap_cost_eur"),
        )
    )
    ranked = global_ranks(products, {"rate_rank": "scrap_rate", "cost_rank": "scrap_cost_eur"})
    return ranked.withColumn("rank_gap", F.col("rate_rank") - F.col("cost_rank"))


def machine_hours(
    demand: DataFrame, products: DataFrame, factors: Sequence[int] = (1, 2, 3, 10)
) -> DataFrame:
    """Capacity check: mean machine hours a day for each scale factor of the demand.

    `products` is the product master; demand times a factor is scaled after the
    daily hours are summed, so the factors multiply a small table.
    """
    rates = products.select("product_name", "machine_id", "ideal_units_per_hr")
    daily = (
        demand.join(rates, "product_name")
        .groupBy("machine_id", "sale_date")
        .agg(hours_sum(ratio(F.col("units"), F.col("ideal_units_per_hr"))).alias("hours"))
    )
    mean = daily.groupBy("machine_id").agg((F.sum("hours") / F.count("hours")).alias("hours"))
    return mean.select(
        "machine_id", "hours", F.explode(F.array(*[F.lit(f) for f in factors])).alias("factor")
    ).select(
        "machine_id",
        "factor",
        exact_round(F.col("hours") * F.col("factor"), 2).alias("hours_per_day"),
    )
