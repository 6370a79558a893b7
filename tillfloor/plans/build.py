"""The whole pipeline over files: till export and fact files to tables, views and checks.

    python -m tillfloor.plans.build <till export csv> <folder of fact csv files> <output folder>
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tillfloor.operators import checks, clean, planning, product, sales
from tillfloor.plans.star import kpi_views, oee_views, register_views, sales_views
from tillfloor.sources.csv import load_fact, read_raw_sales
from tillfloor.sources.inline import machine_table, standards_table
from tillfloor.sources.sinks import commit_version, new_version, write_csv

FACTS = ("fact_production_batch", "fact_downtime", "fact_quality_inspection")


@dataclass
class Build:
    views: dict[str, DataFrame]
    checks: DataFrame
    rows: dict[str, int]
    folder: str
    report: list[str]
    published: bool


def _table(df: DataFrame, out: str, name: str) -> DataFrame:
    """Write a table once; everything downstream reads the file."""
    path = f"{out}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def build(spark: SparkSession, till_csv: str, fact_folder: str, target: str) -> Build:
    """Clean the sales, build the dimensions, load the facts, derive every view.

    Everything goes to a new version folder of `target`, which becomes the current one
    only when every check passes; a failure leaves the last good build in place.
    """
    version = new_version()
    out = f"{target}/{version}"
    cleaned = _table(clean.clean_sales(read_raw_sales(spark, till_csv)), out, "clean_sales")
    write_csv(cleaned, f"{out}/clean_sales_csv")
    lines = clean.sales_base(cleaned)

    machines = _table(machine_table(spark), out, "dim_machine")
    products = _table(
        product.dim_product(lines, standards_table(spark), machines), out, "dim_product"
    )
    rows = {
        name: load_fact(spark, name, f"{fact_folder}/{name}.csv", f"{out}/{name}")
        for name in FACTS
    }
    batches, stops, inspections = (spark.read.parquet(f"{out}/{name}") for name in FACTS)

    timed = lines.withColumnRenamed("datetime", "sale_ts")
    write_csv(sales.dashboard_daily(timed), f"{out}/dashboard_csv")
    demand = sales.daily_demand(lines, products)
    plant = planning.plant_demand(demand)

    kpis = kpi_views(batches, stops, products, machines)
    # read by the identity and OEE checks and by three views: computed once
    kpis["v_batch_oee"] = _table(kpis["v_batch_oee"], out, "v_batch_oee")
    kpis |= oee_views(kpis["v_batch_oee"])
    views = {
        **sales_views(lines),
        "dim_product": products,
        "dim_machine": machines,
        "fact_production_batch": batches,
        "fact_downtime": stops,
        "fact_quality_inspection": inspections,
        "plant_demand": plant,
        **kpis,
    }
    register_views(views)
    every_check = (
        checks.identity_checks(views["v_batch_oee"], views["v_oee_daily"])
        .unionByName(checks.data_checks(
            batches, stops, inspections, products, views["v_batch_oee"], plant
        ))
        .unionByName(checks.contract_checks(stops))
        .unionByName(checks.dimension_checks(products, machines))
    )
    found = checks.report(_table(every_check, out, "checks"))
    good = not any(line.startswith("FAIL") for line in found)
    if good:
        commit_version(spark, target, version)
    return Build(views, spark.read.parquet(f"{out}/checks"), rows, out, found, good)


def main(argv: list[str]) -> int:
    spark = SparkSession.builder.appName("tillfloor build").getOrCreate()
    result = build(spark, *argv)
    for name, count in result.rows.items():
        print(f"  {name:<26} {count:>12,}")
    print("\n".join(result.report))
    return int(not result.published)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
