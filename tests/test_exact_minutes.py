"""Sums of minutes: the same rows from the same data in any order, also at a tie."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tillfloor.operators import downtime, oee

MACHINES = "machine_id int, machine_name string"
STOPS = (
    "machine_id int, batch_id string, reported_reason_code string, reported_reason_label string, "
    "true_reason_code string, was_logged boolean, duration_minutes double, reported_duration_minutes double"
)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(4000):
        minutes = rng.randrange(1, 5000) / 100
        out.append((1, f"B{i % 7}", f"0{i % 4 + 1}", "x", f"0{i % 3 + 1}", True, minutes, minutes))
    # reason 09 sums to 0.3 minutes out of parts that no double holds: an exact tie at two decimals of an hour
    out += [(1, "B1", "09", "x", "09", True, 0.1, 0.1)] * 3
    return out


def test_reports_do_not_depend_on_the_order_of_rows(spark, rows):
    machines = spark.createDataFrame([(1, "Deck")], MACHINES)
    seen = []
    for seed, partitions in ((1, 1), (2, 3), (3, 16)):
        mixed = list(rows)
        random.Random(seed).shuffle(mixed)
        stops = spark.createDataFrame(mixed, STOPS).repartition(partitions)
        seen.append([
            sorted(map(str, f.collect()))
            for f in (
                downtime.downtime_pareto(stops, machines), downtime.pareto_cumulative(stops, machines),
                downtime.reason_coding(stops), downtime.reason_confusion(stops),
                downtime.catchall_split(stops), downtime.catchall_share(stops), oee.logged_stops(stops),
            )
        ])
    assert seen[0] == seen[1] == seen[2]
    tie = downtime.downtime_pareto(spark.createDataFrame(rows, STOPS), machines)
    assert tie.where(F.col("reason_code") == "09").first().stop_hours == 0.01
