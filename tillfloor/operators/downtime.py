"""Downtime reports, and the operator log against the machine counter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillfloor import params as P
from tillfloor.functions import exact_round, minutes_sum, ratio
from tillfloor.operators.oee import clock_hours


def _reasons_by_machine(stops: DataFrame, machines: DataFrame) -> DataFrame:
    """Logged stops by machine and reported reason; the machine name joins last."""
    grouped = (
        stops.where("was_logged")
        .groupBy("machine_id", "reported_reason_code", "reported_reason_label")
        .agg(F.count("*").alias("events"), minutes_sum(F.col("reported_duration_minutes")).alias("minutes"))
    )
    return grouped.join(
        machines.select("machine_id", "machine_name"), "machine_id"
    ).select(
        "machine_id",
        "machine_name",
        F.col("reported_reason_code").alias("reason_code"),
        F.col("reported_reason_label").alias("reason_label"),
        "events",
        "minutes",
    )


def downtime_pareto(stops: DataFrame, machines: DataFrame) -> DataFrame:
    """Events, hours and share of the machine's stop time for each reported reason."""
    machine = Window.partitionBy("machine_id")
    return _reasons_by_machine(stops, machines).select(
        "machine_id",
        "machine_name",
        "reason_code",
        "reason_label",
        "events",
        exact_round(F.col("minutes").cast("double") / 60, 2).alias("stop_hours"),
        exact_round(ratio(F.col("minutes"), F.sum("minutes").over(machine)), 4)
        .alias("share_of_machine_stop_time"),
    )


def pareto_cumulative(stops: DataFrame, machines: DataFrame) -> DataFrame:
    """The running share, largest first; reasons with equal minutes share a value."""
    machine = Window.partitionBy("machine_id")
    running = machine.orderBy(F.desc("minutes")).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return _reasons_by_machine(stops, machines).select(
        "machine_id",
        "machine_name",
        "reason_code",
        "reason_label",
        "events",
        exact_round(F.col("minutes").cast("double") / 60, 2).alias("stop_hours"),
        exact_round(
            ratio(F.sum("minutes").over(running), F.sum("minutes").over(machine)), 4
        ).alias("cumulative_share"),
    )


def _cells(stops: DataFrame) -> DataFrame:
    """Stops by true code, reported code and logged flag: one pass, few rows."""
    return stops.groupBy("true_reason_code", "reported_reason_code", "was_logged").agg(
        F.count("*").alias("events"),
        minutes_sum(F.col("duration_minutes")).alias("true_minutes"),
        minutes_sum(F.col("reported_duration_minutes")).alias("reported_minutes"),
    )


def reason_coding(stops: DataFrame) -> DataFrame:
    """True minutes (all stops) against reported minutes (logged stops) by code.

    Each cell of the small code matrix counts once under its true and once under
    its reported code. That gives every code of either side, as a full outer
    join does, from one pass over the stops; the totals are one more, with no
    shuffle of rows. The result stays lazy, so it can serve as a view.
    """
    cells = _cells(stops)
    none = F.lit(None).cast("decimal(33,4)")
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("true_reason_code").alias("reason_code"),
                    F.col("true_minutes").alias("t"),
                    none.alias("r"),
                    F.lit(True).alias("present"),
                ),
                F.struct(
                    F.col("reported_reason_code").alias("reason_code"),
                    none.alias("t"),
                    F.col("reported_minutes").alias("r"),
                    F.col("was_logged").alias("present"),
                ),
            )
        )
    ).where("present")
    logged_minutes = F.when(F.col("was_logged"), F.col("reported_duration_minutes"))
    totals = stops.agg(
        F.struct(
            minutes_sum(F.col("duration_minutes")).alias("t"), minutes_sum(logged_minutes).alias("r")
        )
        .alias("totals")
    ).scalar()
    true_all, reported_all = totals["t"], totals["r"]
    codes = sides.groupBy("reason_code").agg(F.sum("t").alias("t"), F.sum("r").alias("r"))
    t, r = F.coalesce(F.col("t"), F.lit(0)), F.coalesce(F.col("r"), F.lit(0))
    return codes.select(
        "reason_code",
        exact_round(t.cast("double") / 60, 1).alias("true_stop_hours"),
        exact_round(r.cast("double") / 60, 1).alias("reported_stop_hours"),
        exact_round(ratio(F.col("t"), true_all), 4).alias("true_share"),
        exact_round(ratio(F.col("r"), reported_all), 4).alias("reported_share"),
        exact_round(ratio(r, reported_all) - ratio(t, true_all), 4).alias("share_distortion"),
    )


def unaccounted_time(oee: DataFrame) -> DataFrame:
    """Stop hours by the machine's counter less those in the log, by machine."""
    planned, run = clock_hours("planned_hours"), clock_hours("run_hours")
    logged = clock_hours("logged_stop_hours")
    stopped = planned - run
    return oee.groupBy("machine_id", "machine_name").agg(
        exact_round(stopped, 1).alias("true_stop_hours"),
        exact_round(logged, 1).alias("logged_stop_hours"),
        exact_round(stopped - logged, 1).alias("unaccounted_hours"),
        exact_round(1 - ratio(logged, stopped), 4).alias("unaccounted_share"),
        exact_round(ratio(planned - logged, planned), 4).alias("availability_from_log"),
        exact_round(ratio(run, planned), 4).alias("availability_actual"),
    )


def duration_heaping(stops: DataFrame, rows: int = 5) -> DataFrame:
    """The most frequent reported durations; equal counts by the shorter one."""
    counted = (
        stops.where("was_logged").groupBy("reported_duration_minutes")
        .agg(F.count("*").alias("stops"))
    )
    return counted.orderBy(F.desc("stops"), "reported_duration_minutes").limit(rows)


def heaping_share(stops: DataFrame, step: float = P.PARAMS.round_to_minutes) -> DataFrame:
    """Share of logged durations on a multiple of five: form against counter."""

    def on_step(col: str):
        return F.count_if(F.col(col) % step == 0)

    n = F.count("*")
    return stops.where("was_logged").agg(
        n.alias("logged_stops"),
        exact_round(ratio(on_step("reported_duration_minutes"), n), 4).alias("reported_share"),
        exact_round(ratio(on_step("duration_minutes"), n), 4).alias("counter_share"),
    )


def catchall_share(stops: DataFrame) -> DataFrame:
    """The catch-all code's share of logged minutes and of logged events."""
    other = F.col("reported_reason_code") == P.CATCHALL_CODE
    n = F.count("*")
    return stops.where("was_logged").agg(
        exact_round(
            ratio(
                minutes_sum(F.when(other, F.col("duration_minutes"))),
                minutes_sum(F.col("duration_minutes")),
            ),
            4,
        ).alias("minutes_share"),
        exact_round(ratio(F.count_if(other), n), 4).alias("events_share"),
    )


def logged_share(stops: DataFrame) -> DataFrame:
    n, logged = F.count("*"), F.count_if(F.col("was_logged"))
    return stops.agg(
        n.alias("stops"),
        exact_round(ratio(logged, n), 4).alias("logged_share"),
        exact_round(ratio(n - logged, n), 4).alias("unlogged_share"),
    )


def catchall_split(stops: DataFrame) -> DataFrame:
    """The catch-all bucket by true cause: genuine where the cause is uncategorised."""
    genuine = F.col("true_reason_code") == P.UNCATEGORISED_CODE
    return (
        stops.where(F.col("was_logged") & (F.col("reported_reason_code") == P.CATCHALL_CODE))
        .groupBy("true_reason_code")
        .agg(
            F.count("*").alias("stops"),
            exact_round(minutes_sum(F.col("reported_duration_minutes")).cast("double") / 60, 2).alias("reported_hours"),
        )
        .withColumn("kind", F.when(genuine, "genuine").otherwise("miscoded"))
    )


def reason_confusion(stops: DataFrame) -> DataFrame:
    """Reported code by true code: stops, true hours and reported hours."""
    return stops.groupBy("true_reason_code", "reported_reason_code").agg(
        F.count("*").alias("stops"),
        exact_round(minutes_sum(F.col("duration_minutes")).cast("double") / 60, 2).alias("true_hours"),
        exact_round(minutes_sum(F.col("reported_duration_minutes")).cast("double") / 60, 2).alias("reported_hours"),
    )
