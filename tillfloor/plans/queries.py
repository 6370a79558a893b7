"""Registered queries: name to (session, data folder) to DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillfloor.functions import exact_round
from tillfloor.operators import (
    checks,
    clean,
    downtime,
    oee,
    planning,
    plant,
    product,
    profile,
    sales,
)
from tillfloor.plans import star as S
from tillfloor.plans import stored
from tillfloor.session import stage, staging_folder
from tillfloor.sources import rejects, tables
from tillfloor.sources.inline import category_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def _cost_as_double(df: DataFrame) -> DataFrame:
    """The unit cost as a double, a type that every client compares alike."""
    return df.withColumn("unit_cost_eur", F.col("unit_cost_eur").cast("double"))


def _register(name: str, build: Callable[[S.Star], DataFrame]) -> None:
    def run(spark: SparkSession, data: str) -> DataFrame:
        return build(S.Star(spark, data))

    run.__name__ = name
    QUERIES[name] = run


def _raw(star: S.Star, product: bool = True, date: bool = True) -> DataFrame:
    return tables.raw_sales_lines(star.spark, star.data, product, date)


def _unpriced(star: S.Star) -> DataFrame:
    return tables.ticket_sales(star.spark, star.data, price=False)


def _rated_batches(star: S.Star) -> DataFrame:
    total = F.col("good_units") + F.col("scrap_units")
    return star.batches.select(
        "batch_id",
        "product_id",
        total.alias("total_units"),
        F.try_divide(F.col("scrap_units").cast("double"), total.cast("double"))
        .alias("base_rate"),
    )


def _mean_daily(star: S.Star) -> DataFrame:
    return oee.mean_daily_oee(star.batch_oee, planning.is_sampled(F.col("batch_id")), star.stops)


def _data_checks(star: S.Star) -> DataFrame:
    facts = checks.fact_checks(
        star.batches, star.stops, star.inspections, star.products, star.machines
    )
    return facts.unionByName(checks.demand_checks(star.plant))


def _merged_profile(star: S.Star) -> DataFrame:
    """The lines of each month are profiled apart, half of the months at a time, and merged."""
    lines = _raw(star).withColumn("ticket_number", F.col("ticket_number").cast("bigint"))
    month = F.substring("date", 1, 7)
    even = F.coalesce(F.substring("date", 6, 2).cast("int") % 2 == 0, F.lit(False))
    halves = [profile.partial_profile(lines.where(half), month) for half in (even, ~even)]
    return profile.finish_profile(profile.merge_profiles(*halves))


def _rejects(star: S.Star) -> DataFrame:
    folder = f"{staging_folder(star.spark)}/till-{uuid.uuid4().hex}"
    tables.till_text(star.spark, star.data).write.text(folder)
    scanned = rejects.scan_with_rejects(star.spark, folder, tables.TILL_LINE, header=False)
    return rejects.reject_counts(*rejects.split_rejects(stage(scanned), tables.TILL_LINE))


def _references(star: dict[str, DataFrame]) -> DataFrame:
    """Stops and inspections to batches, batches to products and machines, stops to machines."""
    batch, stop = star["fact_production_batch"], star["fact_downtime"]
    return plant.references(
        {
            "batch": batch.select("batch_id"),
            "product": star["dim_product"].select("product_id"),
            "machine": star["dim_machine"].select("machine_id"),
        },
        {
            "stop to batch": (stop, "batch_id", "batch"),
            "stop to machine": (stop, "machine_id", "machine"),
            "inspection to batch": (star["fact_quality_inspection"], "batch_id", "batch"),
            "batch to product": (batch, "product_id", "product"),
            "batch to machine": (batch, "machine_id", "machine"),
        },
    )


def _catalog(star: S.Star) -> DataFrame:
    S.register_views(star.tables())
    return checks.star_schema(
        {name: star.spark.table(name) for name in S.listed_star_tables(star.spark)}
    )


for _name, _build in {
    # profiling
    "profile_shape": lambda s: profile.shape(_raw(s, product=False, date=False), len(_raw(s).columns)),
    "profile_nulls": lambda s: profile.nulls(_raw(s)),
    "profile_duplicates": lambda s: profile.duplicates(_raw(s)),
    "profile_range": lambda s: profile.value_range(
        _raw(s), "date", "article", F.col("Quantity"), F.col("unit_price") == "0,00 €"
    ),
    "profile_rare_values": lambda s: profile.rare_values(_raw(s, date=False), "article"),
    "profile_describe": lambda s: profile.describe(clean.price_text(_raw(s, date=False)), "unit_price"),
    "profile_merged": _merged_profile,
    "load_rejects": _rejects,
    # cleaning
    "clean_price_text": lambda s: clean.price_text(_raw(s, date=False)),
    "clean_sales": lambda s: clean.clean_sales(_raw(s)),
    "clean_funnel": lambda s: clean.clean_funnel(_raw(s, date=False)),
    "sales_base": lambda s: clean.sales_base(clean.clean_sales(_raw(s))),
    "exclude_catchall": lambda s: sales.top_products(
        clean.without_catchall(s.product_sales, prefix=tables.CATCHALL_PREFIX), "units"
    ),
    # sales KPIs
    "sales_totals": lambda s: sales.totals(s.product_sales),
    "kpi_product": lambda s: sales.product_performance(s.product_sales),
    "kpi_weekday": lambda s: sales.weekday_performance(s.tickets),
    "kpi_month": lambda s: sales.monthly(s.tickets),
    "kpi_hour": lambda s: sales.hourly(s.tickets),
    "ticket_averages": lambda s: sales.ticket_averages(
        tables.sales_lines(s.spark, s.data, date=False)
    ),
    "top_products_units": lambda s: sales.top_products(s.product_sales, "units"),
    "top_products_revenue": lambda s: sales.top_products(s.product_sales, "revenue"),
    "units_vs_revenue_rank": lambda s: sales.rank_units_and_revenue(s.product_sales),
    "weekday_ordered": lambda s: sales.weekday_revenue(s.tickets),
    "weekday_presence": lambda s: sales.weekday_presence(_unpriced(s)),
    "top_months": lambda s: sales.top_months(s.tickets),
    "top_hours": lambda s: sales.top_hours(_unpriced(s)),
    "month_avg_per_open_day": lambda s: sales.month_open_day_average(s.tickets),
    "monthly_trend": lambda s: sales.monthly_trend(s.tickets),
    "product_share": lambda s: sales.product_shares(s.product_sales),
    "morning_share": lambda s: sales.morning_share(_unpriced(s)),
    "weekend_ratio": lambda s: sales.weekend_ratio(s.tickets),
    "dashboard_daily": lambda s: sales.dashboard_daily(s.sales),
    "daily_demand": lambda s: s.demand,
    "trading_days": lambda s: sales.trading_days(s.demand),
    # product master
    "top30_products": lambda s: product.top_by_units(
        s.product_sales.where("quantity > 0").withColumnRenamed("quantity", "units")
    ),
    "manufacturable": lambda s: s.kept,
    "coverage_share": lambda s: product.coverage(s.product_sales, s.kept),
    "classify_products": lambda s: product.classify(s.kept, tables.CATEGORY_NAMES),
    "category_join": lambda s: product.join_categories(
        s.kept, category_table(s.spark, tables.LISTED_CATEGORIES)
    ),
    "price_audit": lambda s: product.price_audit(s.product_sales),
    "median_price": lambda s: product.median_prices(product.price_counts(s.product_sales)),
    "unit_cost": lambda s: _cost_as_double(product.unit_costs(
        product.classify(s.kept, tables.CATEGORY_NAMES),
        product.median_prices(product.price_counts(s.product_sales)),
    )),
    "ideal_rate": lambda s: product.ideal_rates(s.standards, s.machines)
    .join(s.kept.select("product_name"), "product_name", "left_semi")
    .drop("assembly_seconds"),
    "dim_product": lambda s: _cost_as_double(s.dim_product),
    "product_review": lambda s: _cost_as_double(
        product.product_review(s.dim_product, s.machines)
    ),
    # OEE
    "logged_stops": lambda s: oee.logged_stops(s.stops),
    "batch_oee": lambda s: s.batch_oee,
    "oee_daily": lambda s: s.oee_daily,
    "oee_mean_daily": _mean_daily,
    "scrap_by_product": lambda s: oee.scrap_by_product(s.batch_oee),
    "scrap_rank_gap": lambda s: oee.scrap_rank_gap(s.batch_oee),
    "deck_load_hours": lambda s: oee.machine_hours(s.demand, s.routed),
    # downtime
    "downtime_pareto": lambda s: downtime.downtime_pareto(s.stops, s.machines),
    "pareto_cumulative": lambda s: downtime.pareto_cumulative(s.stops, s.machines),
    "reason_coding": lambda s: downtime.reason_coding(s.stops),
    "unaccounted_time": lambda s: downtime.unaccounted_time(s.batch_oee),
    "duration_heaping": lambda s: downtime.duration_heaping(s.stops),
    "heaping_share": lambda s: downtime.heaping_share(s.stops),
    "catchall_share": lambda s: downtime.catchall_share(s.stops),
    "logged_share": lambda s: downtime.logged_share(s.stops),
    "catchall_split": lambda s: downtime.catchall_split(s.stops),
    "true_reason_confusion": lambda s: downtime.reason_confusion(s.stops),
    # planning
    "plant_demand": lambda s: s.plant,
    "min_lot_carry": lambda s: s.lots,
    "batch_plan": lambda s: s.plan.select(
        "product_name", "production_date", "planned_units", "loads_used",
        exact_round(F.col("ideal_minutes"), 6).alias("ideal_minutes"),
        exact_round(F.col("planned_minutes"), 6).alias("planned_minutes"),
    ),
    "dispatch_order": lambda s: s.dispatched.select(
        "production_date", "seq", "product_name", "units"
    ),
    "machine_schedule": lambda s: planning.machine_schedule(s.dispatched).select(
        "production_date", "machine_id", "seq", "product_name", "scheduled_start_ts",
        "scheduled_end_ts",
    ),
    "changeovers": lambda s: planning.changeovers(s.dispatched).select(
        "production_date", "machine_id", "seq", "product_name", "changeover"
    ),
    "batch_keys": lambda s: planning.batch_keys(s.dispatched).select(
        "product_name", "production_date", "seq", "batch_id", "inspection_id",
        planning.stop_key(F.col("batch_id"), F.lit(0)).alias("first_stop_id"),
    ),
    "stop_cap": lambda s: planning.stop_cap(s.stops, s.batches).select(
        "downtime_id", "batch_id", "duration_minutes",
        exact_round(F.col("capped_minutes"), 6).alias("capped_minutes"),
    ),
    "stop_intervals": lambda s: planning.stop_intervals(
        planning.stop_cap(s.stops, s.batches), s.batches
    ).select(
        "downtime_id", "batch_id", "laid_start_ts", "laid_end_ts"
    ),
    "run_time": lambda s: planning.run_time(s.batches, s.stops, s.products).select(
        "batch_id", "run_minutes", "total_units"
    ),
    "stop_bands": lambda s: planning.stop_bands(s.stops),
    "round_durations": lambda s: planning.round_durations(s.stops).select(
        "downtime_id", "duration_minutes", "rounded_minutes"
    ),
    "scrap_costop": lambda s: planning.scrap_with_stops(
        _rated_batches(s), planning.stop_cap(s.stops, s.batches), s.products
    ).select(
        "batch_id", "long_stops", "scrap_rate", "scrap_units", "good_units"
    ),
    "inspection_sample": lambda s: s.inspections.drop("inspection_ts"),
    "reason_labels": lambda s: planning.label_reasons(
        s.stops.select("downtime_id", "reported_reason_code"),
        "reported_reason_code", "reason_label",
    ),
    # the planned plant
    "planned_batch_fact": lambda s: s.planned_batch_fact,
    "planned_downtime_fact": lambda s: s.planned_downtime_fact,
    "planned_inspections": lambda s: plant.inspection_fact(s.planned_batch_fact),
    "planned_balance": lambda s: plant.minute_balance(
        s.planned_batch_fact, s.planned_downtime_fact
    ),
    "planned_oee_daily": lambda s: oee.oee_daily(s.planned_batch_oee),
    "planned_references": lambda s: _references(s.planned_tables()),
    "stored_batch_history": lambda s: stored.batch_history(stored.staged_star(s.planned_tables())),
    "logged_references": lambda s: _references(s.tables()),
    # checks
    "checks_identity": lambda s: checks.identity_checks(s.batch_oee, s.oee_daily),
    "checks_data": _data_checks,
    "checks_contract": lambda s: checks.contract_checks(s.stops),
    "checks_dimension": lambda s: checks.dimension_checks(s.dim_product, s.machines),
    "catalog_tables": _catalog,
}.items():
    _register(_name, _build)
