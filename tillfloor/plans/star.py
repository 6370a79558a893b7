"""The star schema as DataFrames: dimensions, facts and the views over them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tillfloor.operators import downtime, oee, planning, plant, product, sales
from tillfloor.schemas import STAR_TABLES
from tillfloor.session import stage
from tillfloor.sources import tables as T
from tillfloor.sources.inline import machine_table, standards_table


@dataclass
class Star:
    """Lazy tables of one data folder. A query builds only what it touches."""

    spark: SparkSession
    data: str

    @cached_property
    def machines(self) -> DataFrame:
        return machine_table(self.spark)

    @cached_property
    def standards(self) -> DataFrame:
        return standards_table(self.spark, T.STANDARDS)

    @cached_property
    def sales(self) -> DataFrame:
        return T.sales_lines(self.spark, self.data)

    @cached_property
    def product_sales(self) -> DataFrame:
        """Sales summed by part: what a figure by product needs."""
        return T.part_sales(self.spark, self.data)

    @cached_property
    def tickets(self) -> DataFrame:
        """Sales summed to tickets, for figures by date or hour."""
        return T.ticket_sales(self.spark, self.data)

    @cached_property
    def kept(self) -> DataFrame:
        units = self.product_sales.where("quantity > 0").select(
            "product", self.product_sales["quantity"].alias("units")
        )
        return product.manufacturable(product.top_by_units(units), T.EXCLUDED)

    @cached_property
    def dim_product(self) -> DataFrame:
        return product.dim_product(
            self.product_sales, self.standards, self.machines, T.EXCLUDED, T.CATEGORY_NAMES
        )

    @cached_property
    def routed(self) -> DataFrame:
        """The product master without its costs, staged: planning reads it repeatedly."""
        named = product.classify(self.kept, T.CATEGORY_NAMES)
        return stage(product.routed_products(named, self.standards, self.machines))

    @cached_property
    def lines_by_date(self) -> DataFrame:
        """Lines with product and date, without the price."""
        return self.sales.select("product", "sale_date", "quantity")

    @cached_property
    def demand(self) -> DataFrame:
        return sales.daily_demand(self.lines_by_date, self.routed)

    @cached_property
    def plant(self) -> DataFrame:
        return planning.plant_demand(self.demand)

    @cached_property
    def lots(self) -> DataFrame:
        return planning.min_lot_carry(self.plant, self.routed)

    @cached_property
    def plan(self) -> DataFrame:
        return planning.batch_plan(self.lots, self.routed)

    @cached_property
    def dispatched(self) -> DataFrame:
        return planning.dispatch_order(self.plan)

    @cached_property
    def products(self) -> DataFrame:
        return T.products(self.spark, self.data)

    @cached_property
    def batches(self) -> DataFrame:
        return T.batches(self.spark, self.data)

    @cached_property
    def stops(self) -> DataFrame:
        return T.stops(self.spark, self.data)

    @cached_property
    def inspections(self) -> DataFrame:
        return planning.inspection_sample(self.batches)

    @cached_property
    def batch_oee(self) -> DataFrame:
        return oee.batch_oee(self.batches, self.products, self.machines, self.stops)

    @cached_property
    def oee_daily(self) -> DataFrame:
        return oee.oee_daily(self.batch_oee)

    @cached_property
    def planned_batches(self) -> DataFrame:
        """The scheduled plan, staged: the draw, the cap and the facts read it."""
        return stage(plant.scheduled_batches(self.dispatched))

    @cached_property
    def planned_stops(self) -> DataFrame:
        stops = plant.plant_stops(self.stops, self.planned_batches)
        return stage(plant.capped_stops(stops, self.planned_batches))

    @cached_property
    def planned_batch_fact(self) -> DataFrame:
        return plant.batch_fact(self.planned_batches, self.planned_stops, self.routed)

    @cached_property
    def planned_downtime_fact(self) -> DataFrame:
        return plant.downtime_fact(
            self.planned_stops, self.planned_batches, self.planned_batch_fact
        )

    @cached_property
    def planned_batch_oee(self) -> DataFrame:
        """OEE of the planned plant: its batches join the registered product master."""
        return oee.batch_oee(
            self.planned_batch_fact, self.dim_product, self.machines, self.planned_downtime_fact
        )

    def planned_tables(self) -> dict[str, DataFrame]:
        """The star whose batches, stops and inspections all come from the plan."""
        return {
            "dim_product": self.dim_product,
            "dim_machine": self.machines,
            "fact_production_batch": self.planned_batch_fact,
            "fact_downtime": self.planned_downtime_fact,
            "fact_quality_inspection": plant.inspection_fact(self.planned_batch_fact),
        }

    def tables(self) -> dict[str, DataFrame]:
        return {
            "dim_product": self.dim_product,
            "dim_machine": self.machines,
            "fact_production_batch": self.batches,
            "fact_downtime": self.stops,
            "fact_quality_inspection": self.inspections,
        }


def kpi_views(
    batches: DataFrame, stops: DataFrame, products: DataFrame, machines: DataFrame
) -> dict[str, DataFrame]:
    """The KPI views over a star schema, by view name."""
    batch = oee.batch_oee(batches, products, machines, stops)
    return {
        "v_batch_oee": batch,
        **oee_views(batch),
        "v_downtime_pareto": downtime.downtime_pareto(stops, machines),
        "v_dq_reason_coding": downtime.reason_coding(stops),
    }


def oee_views(batch: DataFrame) -> dict[str, DataFrame]:
    """The views over the batch OEE."""
    return {
        "v_oee_daily": oee.oee_daily(batch),
        "v_scrap_by_product": oee.scrap_by_product(batch),
        "v_dq_unaccounted_time": downtime.unaccounted_time(batch),
    }


def sales_views(lines: DataFrame) -> dict[str, DataFrame]:
    """The sales KPI views over `clean.sales_base`, by view name."""
    timed = lines.withColumnRenamed("datetime", "sale_ts")
    return {
        "v_sales": lines,
        "kpi_product_performance": sales.product_performance(timed),
        "kpi_by_day_of_week": sales.weekday_performance(timed),
        "kpi_monthly": sales.monthly(timed),
        "kpi_by_hour": sales.hourly(timed),
    }


def register_views(views: dict[str, DataFrame]) -> None:
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def listed_star_tables(spark: SparkSession) -> list[str]:
    """Names of the star tables in the catalog; raises where one is missing."""
    listed = {t.name for t in spark.catalog.listTables()}
    missing = [name for name in STAR_TABLES if name not in listed]
    if missing:
        raise LookupError(f"the star schema is not complete: {', '.join(missing)}")
    return [name for name in STAR_TABLES if name in listed]
