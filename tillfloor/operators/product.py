"""Product master: the best sellers that are made here, with cost and rate standards.

Everything after the top-product cut has at most `top_products` rows, the bound
that the numbering window relies on. Small tables join without a hint: Spark
knows the size of a limit, an inline table or a file, and broadcasts by it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillfloor import params as P
from tillfloor import schemas
from tillfloor.functions import exact_round, line_count, ratio, revenue_sum
from tillfloor.session import stage


def price_counts(sales: DataFrame) -> DataFrame:
    """Lines and units by product and price: one pass serves units and prices.

    The shuffle carries a row for each product and price of a task, so a product
    with a third of all lines costs no more than any other.
    """
    return sales.where(F.col("quantity") > 0).groupBy("product", "unit_price").agg(
        line_count(sales).alias("lines"), F.sum("quantity").alias("units")
    )


def top_by_units(units: DataFrame, rows: int = P.PARAMS.top_products) -> DataFrame:
    """The best sellers of (product, units); equal ones in name order."""
    total = units.groupBy(F.col("product").alias("product_name")).agg(
        F.sum("units").cast("bigint").alias("v1_total_units")
    )
    return total.orderBy(F.desc("v1_total_units"), "product_name").limit(rows)


def manufacturable(
    top: DataFrame, excluded: Sequence[str] = P.EXCLUDED_PRODUCTS
) -> DataFrame:
    """Exclude after the cut, then number 1..n. The window has at most the cut's rows."""
    order = Window.orderBy(F.desc("v1_total_units"), "product_name")
    return top.where(~F.col("product_name").isin(*excluded)).select(
        F.row_number().over(order).alias("product_id"), "product_name", "v1_total_units"
    )


def coverage(sales: DataFrame, kept: DataFrame) -> DataFrame:
    """Share of all units and revenue that the kept products cover."""
    flags = kept.select(F.col("product_name").alias("product"), F.lit(True).alias("kept"))
    totals = sales.groupBy("product").agg(
        F.sum("quantity").alias("units"), revenue_sum(sales).alias("revenue")
    )
    covered = totals.join(flags, "product", "left")
    return covered.agg(
        F.count("kept").alias("kept_products"),
        exact_round(ratio(F.sum(F.when(F.col("kept"), F.col("units"))), F.sum("units")), 4)
        .alias("unit_share"),
        exact_round(ratio(F.sum(F.when(F.col("kept"), F.col("revenue"))), F.sum("revenue")), 4)
        .alias("revenue_share"),
    )


def classify(
    products: DataFrame,
    category_names: Mapping[str, Sequence[str]] = P.CATEGORY_PRODUCTS,
    default: str = P.DEFAULT_CATEGORY,
) -> DataFrame:
    """Category and process by name lists; whatever is not listed is the default."""
    name = F.col("product_name")
    category: Column = F.lit(default)
    for label, names in reversed(list(category_names.items())):
        category = F.when(name.isin(*names), label).otherwise(category)
    assembled = name.isin(*category_names.get(P.ASSEMBLED_CATEGORY, ()))
    return products.withColumn("product_category", category).withColumn(
        "process_type", F.when(assembled, "assembled").otherwise("baked")
    )


def join_categories(products: DataFrame, categories: DataFrame) -> DataFrame:
    """The same from an inline table by inner join: unlisted products drop out."""
    return products.join(categories, "product_name")


def price_audit(sales: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Does a price ever move? A flat one means an ancillary charge, not a product."""
    if names is not None:
        sales = sales.where(F.col("product").isin(*names))
    by_price = sales.groupBy("product", "unit_price").agg(
        line_count(sales).alias("lines"), F.sum("quantity").alias("units")
    )
    low, high = F.min("unit_price"), F.max("unit_price")
    return (
        by_price.groupBy("product")
        .agg(
            F.sum("lines").alias("times_sold"),
            F.sum("units").alias("units"),
            F.count("unit_price").alias("distinct_prices"),
            low.alias("min_price"),
            high.alias("max_price"),
            exact_round(high - low, 2).alias("price_spread"),
        )
        .orderBy("distinct_prices", "price_spread", "product")
    )


def median_prices(counts: DataFrame) -> DataFrame:
    """Exact median price over lines, from `price_counts`.

    Each price carries its number of lines as frequency, so a product holds one
    entry for each distinct price, however many lines it has.
    """
    priced = counts.where(F.col("unit_price") > 0)
    return priced.groupBy(F.col("product").alias("product_name")).agg(
        exact_round(F.percentile("unit_price", 0.5, F.col("lines")), 4)
        .alias("median_unit_price_eur")
    )


def _cost_ratio(category: Column) -> Column:
    ratio_: Column = F.lit(None).cast("decimal(3,2)")
    for label, share in P.PARAMS.cost_ratio.items():
        ratio_ = F.when(category == label, F.lit(share).cast("decimal(3,2)")).otherwise(ratio_)
    return ratio_


def unit_costs(products: DataFrame, medians: DataFrame) -> DataFrame:
    """Median price times the ratio of the category, to the cent."""
    cost = F.col("median_unit_price_eur").cast("decimal(14,4)") * _cost_ratio(
        F.col("product_category")
    )
    return (
        products.select("product_name", "product_category")
        .join(medians, "product_name")
        .withColumn("unit_cost_eur", F.round(cost, 2).cast("decimal(8,2)"))
    )


def ideal_rates(standards: DataFrame, machines: DataFrame) -> DataFrame:
    """Units an hour at full load: by cycle time, or by seconds where assembled."""
    cycle = F.col("bake_minutes") + F.col("handling_minutes")
    rate = F.when(
        F.col("assembly_seconds").isNotNull(), F.try_divide(F.lit(3600.0), "assembly_seconds")
    ).otherwise(F.col("units_per_full_load") * F.try_divide(F.lit(60.0), cycle))
    return standards.join(
        machines.select("machine_id", "machine_type", "handling_minutes"),
        "machine_id",
    ).withColumn("ideal_units_per_hr", exact_round(rate, 2))


def routed_products(
    products: DataFrame, standards: DataFrame, machines: DataFrame
) -> DataFrame:
    """Products with machine, load size and ideal rate: all that planning reads."""
    rates = ideal_rates(standards, machines).select(
        "product_name", "machine_id", "machine_type", "units_per_full_load", "bake_minutes",
        "ideal_units_per_hr",
    )
    return products.join(rates, "product_name", "left")


def apply_standards(
    products: DataFrame, standards: DataFrame, medians: DataFrame, machines: DataFrame
) -> DataFrame:
    """Update the standards of a product table. Products without a match keep theirs."""
    new = ideal_rates(standards, machines).join(unit_costs(products, medians), "product_name")
    columns = [
        "machine_id", "units_per_full_load", "bake_minutes", "unit_cost_eur",
        "ideal_units_per_hr",
    ]
    new = new.select(
        "product_name", F.lit(True).alias("_matched"), *[F.col(c).alias(f"_{c}") for c in columns]
    )
    updated = products.join(new, "product_name", "left").withColumns(
        {c: F.when(F.col("_matched"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    )
    return updated.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.DIM_PRODUCT]
    )


def dim_product(
    sales: DataFrame,
    standards: DataFrame,
    machines: DataFrame,
    excluded: Sequence[str] = P.EXCLUDED_PRODUCTS,
    category_names: Mapping[str, Sequence[str]] = P.CATEGORY_PRODUCTS,
) -> DataFrame:
    """The whole product master: at most `top_products` rows."""
    from tillfloor.sources.sinks import add_missing_columns

    counts = stage(price_counts(sales))
    kept = manufacturable(
        top_by_units(counts.select("product", "units")), excluded
    )
    bare = add_missing_columns(classify(kept, category_names), schemas.DIM_PRODUCT)
    wanted = counts.join(
        F.broadcast(kept.select(F.col("product_name").alias("product"))), "product", "left_semi"
    )
    return apply_standards(bare, standards, median_prices(wanted), machines)


def product_review(products: DataFrame, machines: DataFrame) -> DataFrame:
    """Products with their machine, by machine and falling rate."""
    return (
        products.join(
            machines.select("machine_id", "machine_name", "handling_minutes"),
            "machine_id",
        )
        .orderBy("machine_id", F.desc("ideal_units_per_hr"), "product_name")
        .select(
            "product_id", "product_name", "product_category", "process_type", "machine_name",
            "units_per_full_load", "bake_minutes", "handling_minutes", "unit_cost_eur",
            "ideal_units_per_hr", "v1_total_units",
        )
    )
