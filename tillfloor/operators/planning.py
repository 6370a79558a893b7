"""From demand to batches, and the event arithmetic of batches and stops.

Demand is at daily grain: a product has at most one row a day, and a machine at
most one batch a day for each of its products, so every window over these is
bounded by the calendar or by the product master. Stops are not bounded for one
batch; see `stop_intervals`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillfloor import params as P
from tillfloor.functions import (
    batch_key,
    exact_round,
    half_even,
    is_sunday,
    minutes_sum,
    plus_minutes,
    ratio,
)
from tillfloor.functions.exprs import md5_fraction
from tillfloor.functions.ordered import even_blocks, total_before
from tillfloor.session import stage
from tillfloor.sources.inline import reason_table

PARAMS = P.PARAMS

# Independent sections of a carry series that one fold takes together: enough
# to keep the groups few, and few enough to keep their arrays short.
SECTIONS_IN_A_FOLD = 32


def plant_demand(demand: DataFrame, factor: int = PARAMS.outlet_factor) -> DataFrame:
    """Scale demand to the plant and bake Sunday's on the Saturday before."""
    day = F.col("sale_date")
    return (
        demand.withColumn("production_date", F.when(is_sunday(day), F.date_sub(day, 1))
                          .otherwise(day))
        .groupBy("product_name", "production_date")
        .agg(F.sum(F.col("units") * factor).alias("units"))
    )


def minimum_lot(load: Column, machine_type: Column, assembled: Column) -> Column:
    """One deck of three, or one tray of eighteen; the bench has no minimum."""
    lots = F.when(machine_type == "deck_oven", PARAMS.deck_lots).otherwise(PARAMS.rack_lots)
    return F.when(assembled, F.lit(0.0)).otherwise(load / lots)


def min_lot_carry(demand: DataFrame, routed: DataFrame) -> DataFrame:
    """Release the demand of a product when it reaches the minimum lot.

    Demand below the lot is carried to the product's next day with demand. A day
    that reaches the lot by itself always releases, whatever was carried, so it
    ends a section of the series. Sections are independent, and the fold with
    reset takes a few at a time: its arrays hold some days. A product whose daily
    demand never reaches the lot has one section, the calendar at most.
    `routed` is the product master with machine types (`product.routed_products`).
    """
    lots = routed.select(
        "product_name",
        F.coalesce(
            minimum_lot(
                F.col("units_per_full_load"),
                F.col("machine_type"),
                F.col("process_type") == "assembled",
            ),
            F.lit(0.0),
        ).alias("min_units"),
    )

    def enough(units: Column) -> Column:
        return (units >= F.col("min_units")) & (half_even(units) >= 1)

    earlier = (
        Window.partitionBy("product_name").orderBy("production_date")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ended = F.coalesce(F.sum(enough(F.col("units")).cast("int")).over(earlier), F.lit(0))
    sections = demand.join(lots, "product_name").withColumn(
        "section", F.floor(ended / SECTIONS_IN_A_FOLD)
    )
    days = F.array_sort(F.collect_list(F.struct("production_date", "units")))
    state = F.struct(
        F.lit(0.0).alias("carry"),
        F.array().cast("array<struct<production_date:date,units:double>>").alias("released"),
    )

    def step(acc: Column, day: Column) -> Column:
        units = acc["carry"] + day["units"]
        lot = F.struct(day["production_date"].alias("production_date"), units.alias("units"))
        return F.struct(
            F.when(enough(units), F.lit(0.0)).otherwise(units).alias("carry"),
            F.when(enough(units), F.concat(acc["released"], F.array(lot)))
            .otherwise(acc["released"]).alias("released"),
        )

    return (
        sections.groupBy("product_name", "section", "min_units")
        .agg(days.alias("days"))
        .select(
            "product_name",
            F.inline(F.aggregate("days", state, step, lambda acc: acc["released"])),
        )
    )


def batch_plan(lots: DataFrame, products: DataFrame) -> DataFrame:
    """Size each released lot: units, loads and planned minutes."""
    standards = products.select(
        "product_name", "product_id", "machine_id", "units_per_full_load", "process_type",
        "product_category", "ideal_units_per_hr",
    )
    loads = F.when(F.col("process_type") == "assembled", F.lit(0.0)).otherwise(
        half_even(ratio(F.col("units"), F.col("units_per_full_load")), 4)
    )
    ideal = ratio(F.col("planned_units"), F.col("ideal_units_per_hr")) * 60
    return (
        lots.join(standards, "product_name")
        .withColumn("planned_units", half_even(F.col("units")).cast("bigint"))
        .where(F.col("planned_units") > 0)
        .withColumn("loads_used", loads)
        .withColumn("ideal_minutes", ideal)
        .withColumn("planned_minutes", F.col("ideal_minutes") / PARAMS.planning_efficiency)
    )


def dispatch_order(plan: DataFrame) -> DataFrame:
    """Number the batches of a day: largest first, equal ones in name order."""
    day = Window.partitionBy("production_date").orderBy(F.desc("units"), "product_name")
    return plan.withColumn("seq", F.row_number().over(day))


def machine_schedule(dispatched: DataFrame) -> DataFrame:
    """Start and end of each batch: the batches of a machine follow each other from shift start."""
    before = (
        Window.partitionBy("production_date", "machine_id").orderBy("seq")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    elapsed = F.coalesce(F.sum("planned_minutes").over(before), F.lit(0.0))
    shift = F.col("production_date").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(PARAMS.shift_start_hour)
    )
    return (
        dispatched.withColumn("elapsed_minutes", elapsed)
        .withColumn("scheduled_start_ts", plus_minutes(shift, F.col("elapsed_minutes")))
        .withColumn(
            "scheduled_end_ts",
            plus_minutes(shift, F.col("elapsed_minutes") + F.col("planned_minutes")),
        )
    )


def changeovers(dispatched: DataFrame) -> DataFrame:
    """Flag the batches that follow another product on their machine that day."""
    line = Window.partitionBy("production_date", "machine_id").orderBy("seq")
    previous = F.lag("product_name").over(line)
    return dispatched.withColumn(
        "changeover", F.coalesce(previous != F.col("product_name"), F.lit(False)).cast("int")
    )


def batch_keys(dispatched: DataFrame) -> DataFrame:
    """Batch id from date, product and sequence, and the inspection id from it."""
    key = batch_key(F.col("production_date"), F.col("product_id"), F.col("seq"))
    return dispatched.withColumn("batch_id", key).withColumn(
        "inspection_id", F.concat(F.lit("I"), F.substring("batch_id", 2, 12))
    )


def stop_key(batch_id: Column, number: Column) -> Column:
    return F.concat_ws(
        "-", F.concat(F.lit("D"), F.substring(batch_id, 2, 64)), number.cast("string")
    )


def batch_stop_totals(stops: DataFrame) -> DataFrame:
    """Stop minutes by batch."""
    return stops.groupBy("batch_id").agg(
        minutes_sum(F.col("duration_minutes")).cast("double").alias("stop_minutes")
    )


def long_stop_counts(capped: DataFrame) -> DataFrame:
    """By batch, the stops that are still long enough to be logged after the cap.

    Six decimals drop the noise of the factor at the limit itself.
    """
    long_enough = F.round("capped_minutes", 6) >= PARAMS.logged_from_minutes
    return capped.groupBy("batch_id").agg(F.count_if(long_enough).alias("long_stops"))


def stop_cap(stops: DataFrame, batches: DataFrame) -> DataFrame:
    """Scale a batch's stops down where they exceed the capped planned time.

    The factor is found at batch grain and joined back, so a batch with very
    many stops is never one window partition. The factors are staged: the join
    then sees their size and may broadcast them, or split a skewed batch.
    """
    planned = batches.select("batch_id", "planned_production_minutes")
    cap = F.col("planned_production_minutes") * PARAMS.stop_cap
    factors = stage(
        batch_stop_totals(stops)
        .join(planned, "batch_id")
        .where(F.col("stop_minutes") > cap)
        .select("batch_id", ratio(cap, F.col("stop_minutes")).alias("factor"))
    )
    return stops.join(factors, "batch_id", "left").withColumn(
        "capped_minutes", F.col("duration_minutes") * F.coalesce(F.col("factor"), F.lit(1.0))
    ).drop("factor")


def stop_intervals(
    stops: DataFrame, batches: DataFrame, order: str = "start_ts", key: str = "downtime_id",
    minutes: str = "capped_minutes",
) -> DataFrame:
    """Lay the stops of a batch end to end from its start, each as long as `minutes` says.

    Laid out of `stop_cap`, no stop ends after its batch.

    The running total is cut into blocks of near-equal rows along the order, so one batch
    with a third of all stops, also a burst of them in one hour, spreads over many tasks.
    """
    starts = batches.select("batch_id", F.col("actual_start_ts").alias("batch_start_ts"))
    blocks = even_blocks(stops, ["batch_id", order, key], "block_")
    laid = total_before(
        blocks, minutes, [F.col(order), F.col(key)], "offset_minutes", F.col("block_"), within=["batch_id"],
    ).drop("block_").join(starts, "batch_id")
    offset = F.col("offset_minutes")
    return laid.withColumn(
        "laid_start_ts", plus_minutes(F.col("batch_start_ts"), offset)
    ).withColumn(
        "laid_end_ts",
        plus_minutes(F.col("batch_start_ts"), offset + F.col(minutes)),
    )


def run_time(
    batches: DataFrame,
    stops: DataFrame,
    products: DataFrame,
    achieved_rate: float = PARAMS.achieved_rate,
) -> DataFrame:
    """Run minutes are planned minus stopped; output is floored, never rounded up.

    A batch that makes nothing is not a batch: it drops out, and `of_batches` drops
    what belongs to it. Capped stops add up to the capped total, so batch totals are enough here.
    """
    totals = batch_stop_totals(stops).select("batch_id", "stop_minutes")
    rates = products.select("product_id", "ideal_units_per_hr")
    planned = F.col("planned_production_minutes")
    stopped = F.when(
        F.col("stop_minutes").isNotNull(),
        F.least(F.col("stop_minutes"), planned * PARAMS.stop_cap),
    ).otherwise(0.0)
    run = planned - stopped
    made = F.col("run_minutes") / 60.0 * F.col("ideal_units_per_hr") * achieved_rate
    return (
        batches.join(totals, "batch_id", "left")
        .join(rates, "product_id")
        .withColumn("run_minutes", exact_round(run, 6))
        .withColumn("total_units", F.floor(F.round(made, 6)).cast("bigint"))
        .where(F.col("total_units") >= 1)
    )


def of_batches(rows: DataFrame, batches: DataFrame) -> DataFrame:
    """Stops or inspections of the batches that are left."""
    return rows.join(batches.select("batch_id"), "batch_id", "left_semi")


def stop_band(minutes: Column) -> Column:
    short, middle = PARAMS.band_edges
    return (
        F.when(minutes < short, "under_10_min")
        .when(minutes < middle, "under_30_min")
        .otherwise("over_30_min")
    )


def stop_bands(stops: DataFrame) -> DataFrame:
    """Observed miscoding by duration band: logged stops that report another code."""
    minutes = F.col("duration_minutes")
    logged = minutes >= PARAMS.logged_from_minutes
    miscoded = F.col("reported_reason_code") != F.col("true_reason_code")
    return stops.groupBy(stop_band(minutes).alias("band")).agg(
        F.count("*").alias("stops"),
        F.count_if(logged).alias("logged_stops"),
        F.count_if(logged & miscoded).alias("miscoded_stops"),
        exact_round(ratio(F.count_if(logged & miscoded), F.count_if(logged)), 4)
        .alias("miscoding_rate"),
    )


def rounded_minutes(minutes: Column, step: float = PARAMS.round_to_minutes) -> Column:
    """To the nearest step, half to even, and one step at least."""
    return F.greatest(F.lit(step), half_even(minutes / step) * step)


def round_durations(stops: DataFrame) -> DataFrame:
    return stops.withColumn("rounded_minutes", rounded_minutes(F.col("duration_minutes")))


def scrap_with_stops(
    batches: DataFrame, stops: DataFrame, products: DataFrame, base_rate: str = "base_rate"
) -> DataFrame:
    """Scrap rises with every stop long enough to cool the oven, up to a cap.

    `batches` brings `total_units` and its scrap rate without stops, `base_rate`;
    `stops` come out of `stop_cap`, since a stop may be short after it.
    """
    categories = products.select("product_id", "product_category")
    factor: Column = F.lit(1.0)
    for label, value in PARAMS.scrap_multiplier.items():
        factor = F.when(F.col("product_category") == label, F.lit(value)).otherwise(factor)
    long_stops = long_stop_counts(stops)
    raised = F.col(base_rate) * factor + F.col("long_stops") * PARAMS.scrap_per_stop
    return (
        batches.join(long_stops, "batch_id", "left")
        .join(categories, "product_id")
        .withColumn("long_stops", F.coalesce(F.col("long_stops"), F.lit(0)))
        .withColumn("scrap_rate", exact_round(F.least(raised, F.lit(PARAMS.scrap_cap)), 8))
        .withColumn(
            "scrap_units", half_even(F.round(F.col("total_units") * F.col("scrap_rate"), 6))
            .cast("bigint"),
        )
        .withColumn("good_units", F.col("total_units") - F.col("scrap_units"))
    )


def is_sampled(batch_id: Column, rate: float = PARAMS.inspection_rate) -> Column:
    """Whether a batch is inspected: its id decides."""
    return md5_fraction(batch_id) < rate


def inspection_sample(batches: DataFrame, rate: float = PARAMS.inspection_rate) -> DataFrame:
    """A repeatable sample of batches with sample size and outcome.

    The batch id decides, so the sample is the same at any partitioning and
    after any retry.
    """
    total = F.col("good_units") + F.col("scrap_units")
    failed = ratio(F.col("scrap_units"), total) > PARAMS.fail_scrap_rate
    size = F.least(
        F.lit(PARAMS.sample_max),
        F.greatest(F.lit(PARAMS.sample_min), F.floor(total / PARAMS.sample_divisor).cast("int")),
    )
    return batches.where(is_sampled(F.col("batch_id"), rate)).select(
        F.concat(F.lit("I"), F.substring("batch_id", 2, 64)).alias("inspection_id"),
        "batch_id",
        "production_date",
        F.col("actual_end_ts").alias("inspection_ts"),
        size.alias("sample_size"),
        F.when(failed, "FAIL").otherwise("PASS").alias("outcome"),
    )


def label_reasons(stops: DataFrame, code: str, label: str) -> DataFrame:
    """Look a reason label up in the inline code table; unknown codes get NULL."""
    codes = reason_table(stops.sparkSession).select(
        F.col("reason_code").alias("_code"), F.col("reason_label").alias(label)
    )
    return stops.drop(label).join(
        F.broadcast(codes), F.col(code) == F.col("_code"), "left"
    ).drop("_code")
