"""Data checks: rows of (check_group, check_name, violations); zero violations pass.

Checks over one table are conditional counts of a single pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillfloor import params as P
from tillfloor.functions import exact_round, is_sunday, minutes_sum, ratio
from tillfloor.operators import oee

PARAMS = P.PARAMS


class CheckFailure(RuntimeError):
    """One or more data checks have violations."""


def _rows(one_row: DataFrame, group: str) -> DataFrame:
    """One aggregate row to a row for each check."""
    filled = one_row.select(
        *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("bigint").alias(c) for c in one_row.columns]
    )
    return filled.unpivot([], filled.columns, "check_name", "violations").select(
        F.lit(group).alias("check_group"), "check_name", "violations"
    )


def _counts(df: DataFrame, group: str, checks: dict[str, Column]) -> DataFrame:
    return _rows(df.agg(*[F.count_if(c).alias(name) for name, c in checks.items()]), group)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _differs(tolerance: float) -> Column:
    product = F.col("availability") * F.col("performance") * F.col("quality")
    return F.abs(product - F.col("oee")) > tolerance


def identity_checks(batch_oee: DataFrame, daily: DataFrame) -> DataFrame:
    """The OEE terms multiply to OEE, at batch grain and after the roll-up."""
    missing = reduce(lambda a, b: a | b, [F.col(t).isNull() for t in oee.TERMS])
    return _union([
        _counts(batch_oee, "identity", {
            "terms multiply to OEE at batch grain": _differs(1e-6),
            "no OEE term is NULL": missing,
        }),
        _counts(daily, "identity", {"terms multiply to OEE by day": _differs(1e-3)}),
    ])


def _batch_rules() -> dict[str, Column]:
    run, planned = F.col("run_time_minutes"), F.col("planned_production_minutes")
    return {
        "run time positive and within planned": (run <= 0) | (run > planned + 1e-6),
        "no production on a Sunday": is_sunday(F.col("production_date")),
        "scrap not negative and good units positive":
            (F.col("scrap_units") < 0) | (F.col("good_units") <= 0),
    }


def _oee_rules(terms: dict[str, Column]) -> dict[str, Column]:
    a, p, q = terms["availability"], terms["performance"], terms["quality"]
    return {
        "performance within 1": p > 1.0,
        "every OEE term inside (0, 1]": (a > 1.0) | (q > 1.0) | (a <= 0) | (q <= 0) | (p <= 0),
    }


def batch_checks(batches: DataFrame) -> DataFrame:
    return _counts(batches, "data", _batch_rules())


def oee_checks(batch_oee: DataFrame) -> DataFrame:
    return _counts(batch_oee, "data", _oee_rules({c: F.col(c) for c in oee.TERMS}))


def fact_checks(
    batches: DataFrame,
    stops: DataFrame,
    inspections: DataFrame,
    products: DataFrame,
    machines: DataFrame | None = None,
) -> DataFrame:
    """Every check of the three facts in one aggregate over one join, each fact read once.

    Stops and inspections are counted by batch before they meet the batches in full outer
    joins by the same key; a row without a batch is an orphan. Where machines are given, the OEE
    terms are checked too, for batches whose product and machine are known.
    """
    stopped = stops.groupBy("batch_id").agg(
        minutes_sum(F.col("duration_minutes")).cast("double").alias("stopped"), F.count("*").alias("stops")
    )
    seen = inspections.groupBy("batch_id").agg(F.count("*").alias("inspected"))
    routes = products.select(
        "product_id", "ideal_units_per_hr", F.col("machine_id").alias("routed"), F.lit(True).alias("is_product")
    )
    joined = (
        batches.select(
            "batch_id", "product_id", "machine_id", "production_date", "planned_production_minutes",
            "run_time_minutes", "good_units", "scrap_units", F.lit(True).alias("is_batch"),
        )
        .join(stopped, "batch_id", "full_outer").join(seen, "batch_id", "full_outer")
        .join(routes, "product_id", "left")
    )
    known, product_known = F.col("is_batch").isNotNull(), F.col("is_product").isNotNull()
    gap = F.col("planned_production_minutes") - F.col("run_time_minutes")
    rules = {name: known & rule for name, rule in _batch_rules().items()}
    rules["run time plus stops equals planned"] = (
        known & (F.abs(gap - F.coalesce(F.col("stopped"), F.lit(0.0))) > 0.05)
    )
    rules["no orphan batches"] = known & ~product_known
    rules["batch machine matches the routing"] = product_known & (F.col("machine_id") != F.col("routed"))
    if machines is not None:
        plant = machines.select("machine_id", F.lit(True).alias("is_machine"))
        joined = joined.join(plant, "machine_id", "left")
        runs = product_known & F.col("is_machine").isNotNull()
        rules |= {name: runs & rule for name, rule in _oee_rules(oee.terms()).items()}
    return _rows(
        joined.agg(
            *[F.count_if(rule).alias(name) for name, rule in rules.items()],
            F.sum(F.when(~known, F.col("stops"))).alias("no orphan stops"),
            F.sum(F.when(~known, F.col("inspected"))).alias("no orphan inspections"),
        ),
        "data",
    )


def demand_checks(plant: DataFrame) -> DataFrame:
    return _counts(plant, "data", {"no Sunday demand left": is_sunday(F.col("production_date"))})


def data_checks(
    batches: DataFrame,
    stops: DataFrame,
    inspections: DataFrame,
    products: DataFrame,
    batch_oee: DataFrame,
    plant: DataFrame,
) -> DataFrame:
    """The checks of a stored star, its stored OEE view among them."""
    return _union([
        oee_checks(batch_oee),
        fact_checks(batches, stops, inspections, products),
        demand_checks(plant),
    ])


def contract_checks(
    stops: DataFrame, min_share: float = PARAMS.catchall_min_share
) -> DataFrame:
    """The known distortions of the operator log are as described."""
    true, reported = F.col("true_reason_code"), F.col("reported_reason_code")
    logged, minutes = F.col("was_logged"), F.col("duration_minutes")
    catchall = reported == P.CATCHALL_CODE
    genuine = F.count_if((true == P.UNCATEGORISED_CODE) & catchall)
    share = ratio(
        F.sum(F.when(logged & catchall, minutes)), F.sum(F.when(logged, minutes))
    )
    material = F.coalesce(share > min_share, F.lit(False))
    return _rows(
        stops.agg(
            F.count_if(catchall & (true == P.CATCHALL_CODE))
            .alias("catch-all is never a true cause"),
            F.count_if((true == P.MICRO_STOP_CODE) & logged).alias("no micro-stop is logged"),
            F.when(genuine > 0, 0).otherwise(1).alias("some catch-all is genuine"),
            F.when(material, 0).otherwise(1).alias("catch-all share is material"),
        ),
        "contract",
    )


def machine_checks(machines: DataFrame) -> DataFrame:
    """The machine master: three rows, and rates that follow the equipment."""
    rate, handling = F.col("base_failure_rate_per_hr"), F.col("handling_minutes")

    def of(machine: int, col: Column) -> Column:
        return F.max(F.when(F.col("machine_id") == machine, col))

    def greater(col: Column) -> Column:
        holds = F.coalesce(of(1, col) > of(2, col), F.lit(False))
        return F.when(holds, 0).otherwise(1)

    return _rows(
        machines.agg(
            F.abs(F.count("*") - PARAMS.machines_expected).alias("machine count"),
            F.count_if(rate.isNull() | (rate < 0)).alias("failure rate present"),
            greater(rate).alias("older oven fails more often"),
            greater(handling).alias("deck handling slower than rack"),
        ),
        "dimension",
    )


def product_checks(products: DataFrame, machines: DataFrame) -> DataFrame:
    """The product master: complete, positive, routed by category, rates reproducible."""
    machine, category = F.col("machine_id"), F.col("product_category")
    units, rate, cost = (
        F.col("v1_total_units"), F.col("ideal_units_per_hr"), F.col("unit_cost_eur")
    )
    load, bake = F.col("units_per_full_load"), F.col("bake_minutes")
    baked = F.col("process_type") == "baked"
    routed = reduce(
        lambda a, b: a | b,
        [(category == c) & (machine == m) for c, m in PARAMS.category_machines.items()],
    )
    implied = exact_round(
        load * F.try_divide(F.lit(60.0), bake + F.col("handling_minutes")), 2
    )
    peak_rack = F.max(F.when(machine == 2, rate))
    peak_deck = F.max(F.when(machine == 1, rate))
    rack_leads = F.coalesce(peak_rack > peak_deck, F.lit(False))
    joined = products.join(
        machines.select("machine_id", "handling_minutes"), "machine_id", "left"
    )
    return _rows(
        joined.agg(
            F.abs(F.count("*") - PARAMS.products_expected).alias("product count"),
            F.count_if(units.isNull() | (units <= 0)).alias("demand anchor present"),
            F.count_if(machine.isNull() | cost.isNull() | rate.isNull())
            .alias("standards present"),
            F.count_if((cost <= 0) | (rate <= 0)).alias("standards positive"),
            F.count_if(~routed).alias("category agrees with machine"),
            F.abs(F.count_if(machine == 3) - 1).alias("exactly one bench product"),
            F.count_if(baked & (load.isNull() | bake.isNull()))
            .alias("baked items have load and bake time"),
            F.count_if(baked & (F.abs(rate - implied) > 0.01)).alias("rate follows its inputs"),
            F.when(rack_leads, 0).otherwise(1).alias("rack peak rate above deck"),
        ),
        "dimension",
    )


def dimension_checks(products: DataFrame, machines: DataFrame) -> DataFrame:
    return _union([product_checks(products, machines), machine_checks(machines)])


def total_checks(totals: DataFrame, expected: dict[str, float]) -> DataFrame:
    """Golden totals: a column that differs from its expected value is a violation."""
    return _counts(totals, "totals", {
        f"{name} as expected": ~F.col(name).eqNullSafe(F.lit(value))
        for name, value in expected.items()
    })


def star_schema(tables: dict[str, DataFrame]) -> DataFrame:
    """The star tables with their row counts; each must be registered as a view."""
    parts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
        for n, df in tables.items()
    ]
    return _union(parts)


def report(checks: DataFrame) -> list[str]:
    """One line for each check: ok, or FAIL with the count."""
    return [
        f"{'ok  ' if r.violations == 0 else 'FAIL'} [{r.check_group}] {r.check_name}"
        + ("" if r.violations == 0 else f" ({r.violations})")
        for r in checks.collect()
    ]


def require_passed(checks: DataFrame) -> None:
    failed = [r for r in checks.collect() if r.violations]
    if failed:
        raise CheckFailure(
            "; ".join(f"{r.check_group}: {r.check_name} ({r.violations})" for r in failed)
        )
