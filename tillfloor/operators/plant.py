"""One coherent plant: batches planned from demand, the stops laid into them, and inspections.

The steps of `planning` in a chain, with every declared column of the facts. Batches are made for the rows of the
product master, so product and machine of a batch are those of `dim_product`. Where the plan leaves something to
chance, the event log decides, or the expected value: stops are the logged events, each drawn to one batch by its
number; a changeover lasts its mean; output and scrap start from their mean rates.

Demand is at daily grain, so the plan is bounded by calendar and products. Stops are not: they grow with
the event log, and are only ever combined by batch, cut into slices, or joined to unique keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillfloor import params as P
from tillfloor.functions import exact_round
from tillfloor.functions.ordered import total_before
from tillfloor.operators import planning
from tillfloor.schemas import FACT_BATCH, FACT_DOWNTIME, FACT_INSPECTION

PARAMS = P.PARAMS
CHANGEOVER_CODE = "01"


def scheduled_batches(dispatched: DataFrame) -> DataFrame:
    """Each dispatched lot with its key, schedule, changeover flag and number in the whole plan, from 0."""
    flagged = planning.changeovers(planning.machine_schedule(planning.batch_keys(dispatched)))
    day = F.col("production_date")
    numbered = total_before(
        flagged.withColumn("_one", F.lit(1)), "_one", [day, F.col("seq")], "batch_no", F.unix_date(day)
    ).drop("_one")
    return numbered.withColumns({
        "batch_no": F.coalesce("batch_no", F.lit(0)),
        "actual_start_ts": F.col("scheduled_start_ts"),
        "actual_end_ts": F.col("scheduled_end_ts"),
        "planned_production_minutes": F.col("planned_minutes"),
    })


def plant_stops(events: DataFrame, batches: DataFrame) -> DataFrame:
    """Stops of the plan before the cap: the changeovers, and each logged event on the batch that its number draws.

    `events` are stops as logged, with `downtime_id` D and a number. The number of batches is
    a scalar, and the draw joins unique batch numbers.
    """
    number = F.substring("downtime_id", 2, 20).cast("bigint")
    batch_count = batches.select(F.greatest(F.count("*"), F.lit(1))).scalar()
    drawn = events.select(
        number.alias("event_no"),
        (number * 7919 % batch_count).alias("batch_no"),
        "start_ts",
        "duration_minutes",
        "true_reason_code",
    ).join(batches.select("batch_no", "batch_id"), "batch_no")
    switches = batches.where("changeover = 1").select(
        F.lit(None).cast("bigint").alias("event_no"),
        F.lit("1900-01-01").cast("timestamp_ntz").alias("start_ts"),
        F.lit(PARAMS.changeover_minutes).alias("duration_minutes"),
        F.lit(CHANGEOVER_CODE).alias("true_reason_code"),
        "batch_id",
    )
    stops = switches.unionByName(drawn.drop("batch_no"))
    # the event's own number, which needs no window; a changeover is number 0 of its batch
    at = F.coalesce(F.col("event_no") + 1, F.lit(0))
    return stops.withColumn("downtime_id", planning.stop_key(F.col("batch_id"), at))


def capped_stops(stops: DataFrame, batches: DataFrame) -> DataFrame:
    """Stops scaled to what their batch may lose, with what the operator would have written."""
    capped = planning.stop_cap(stops, batches)
    minutes, event = F.round("capped_minutes", 6), F.col("event_no")
    logged = minutes >= PARAMS.logged_from_minutes
    short, middle = PARAMS.band_edges
    wrong: Column = ((minutes < short) & (event % 2 == 0)) | ((minutes < middle) & (event % 3 == 0))
    other = (F.col("true_reason_code") == P.UNCATEGORISED_CODE) | (logged & F.coalesce(wrong, F.lit(False)))
    typed = logged & (F.coalesce(event % 4, F.lit(1)) != 0)
    return capped.withColumns({
        "was_logged": logged,
        "reported_reason_code": F.when(other, P.CATCHALL_CODE).otherwise(F.col("true_reason_code")),
        "reported_duration_minutes": F.when(typed, planning.rounded_minutes(minutes)).otherwise(minutes),
    })


def batch_fact(batches: DataFrame, stops: DataFrame, products: DataFrame) -> DataFrame:
    """Every declared column of the batch fact: run time after the capped stops, output, scrap with the stops.

    `stops` are capped. A batch that makes nothing drops out.
    """
    minutes = stops.select("batch_id", F.col("capped_minutes").alias("duration_minutes"))
    ran = planning.run_time(batches.drop("ideal_units_per_hr"), minutes, products)
    rated = ran.withColumn("base_rate", F.lit(PARAMS.base_scrap_rate)).drop("product_category")
    made = planning.scrap_with_stops(rated, stops, products)
    return made.withColumns({
        "planned_production_minutes": exact_round(F.col("planned_production_minutes"), 2),
        "run_time_minutes": exact_round(F.col("run_minutes"), 2),
        "product_id": F.col("product_id").cast("bigint"),
    }).select(*FACT_BATCH.names)


def downtime_fact(stops: DataFrame, batches: DataFrame, made: DataFrame) -> DataFrame:
    """Every declared column of the stop fact, laid end to end from the batch's start; `made` is the batch fact."""
    # whole milliseconds, so that sums do not depend on their order
    timed = stops.withColumn("laid_minutes", F.round(F.col("capped_minutes") * 60000) / 60000)
    laid = planning.stop_intervals(planning.of_batches(timed, made), batches, minutes="laid_minutes")
    attributes = batches.select("batch_id", "machine_id", "production_date")
    labelled = planning.label_reasons(
        planning.label_reasons(laid, "reported_reason_code", "reported_reason_label"),
        "true_reason_code", "true_reason_label",
    )
    return labelled.join(attributes, "batch_id").withColumns({
        "start_ts": F.col("laid_start_ts"),
        "end_ts": F.col("laid_end_ts"),
        "duration_minutes": exact_round(F.col("capped_minutes"), 6),
    }).select(*FACT_DOWNTIME.names)


def inspection_fact(made: DataFrame) -> DataFrame:
    """All eight declared columns. Defects are drawn by chance and have no expected text: NULL."""
    kinds = {f.name: f.dataType for f in FACT_INSPECTION}
    found = planning.inspection_sample(made).withColumns({
        name: F.lit(None).cast(kinds[name]) for name in ("defects_found", "defect_type")
    })
    return found.select(*FACT_INSPECTION.names)


def minute_balance(made: DataFrame, stops: DataFrame) -> DataFrame:
    """Each batch's planned, run and laid minutes, and whether the stops fill what was not run."""
    laid = planning.batch_stop_totals(stops).select("batch_id", F.col("stop_minutes").alias("laid"))
    lost = F.col("planned_production_minutes") - F.col("run_time_minutes")
    filled = F.coalesce("laid", F.lit(0.0))
    return made.join(laid, "batch_id", "left").select(
        "batch_id",
        "planned_production_minutes",
        "run_time_minutes",
        exact_round(filled, 2).alias("laid_minutes"),
        (F.abs(lost - filled) <= 0.05).alias("balanced"),
    )


def references(parents: dict[str, DataFrame], children: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """For each reference, its rows, orphan rows and different orphan keys: all of them in one grouped union.

    `parents` maps a name to a frame with its key as the only column. `children` maps a reference's name to
    (frame, column, parent). Each side is counted by key first, so a key with a third of all rows is one row in the
    shuffle; then keys of all references meet once, where a row without a parent is an orphan.
    A NULL refers to nothing: its rows are orphans, but it is no key.
    """
    key = F.col("key").cast("string")
    rows = None
    for name, (child, column, parent) in children.items():
        held = parents[parent].distinct()
        counted = child.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n"))
        sides = counted.select(
            F.lit(name).alias("reference"), key.alias("key"), "n", F.lit(0).alias("parent")
        ).union(held.select(
            F.lit(name), F.col(held.columns[0]).cast("string"), F.lit(0).cast("bigint"), F.lit(1)
        ))
        rows = sides if rows is None else rows.union(sides)
    met = rows.groupBy("reference", "key").agg(F.sum("n").alias("n"), F.max("parent").alias("parent"))
    orphan = (F.col("parent") == 0) | F.col("key").isNull()
    return met.groupBy("reference").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(orphan, F.col("n"))), F.lit(0)).alias("orphan_rows"),
        F.count_if(orphan & F.col("key").isNotNull()).alias("orphan_keys"),
    )
