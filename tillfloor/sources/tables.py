"""Parquet tables read as sales lines, products, batches and stops.

The adapter only renames and derives columns; joins that a caller does not need
are left out, and no join is hinted: the tables grow with the data, so Spark
chooses broadcast or sort-merge by measured size and splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillfloor import params as P
from tillfloor.functions import half_even, is_sunday, money, plus_minutes
from tillfloor.schemas import SOURCE_TABLES

# Product names are an adjective and a noun; the noun gives the category.
ADJECTIVES = ("blue", "cold", "hot", "large", "new", "old", "red", "small")
NOUN_CATEGORY = {
    "bolt": "bread", "rod": "bread", "plate": "bread", "ring": "bread",
    "widget": "viennoiserie", "gizmo": "viennoiserie",
    "gear": "patisserie", "anvil": "sandwich",
}
# machine_id, units_per_full_load, bake_minutes, assembly_seconds
CATEGORY_STANDARDS = {
    "bread": (1, 90, 24.0, None),
    "viennoiserie": (2, 288, 18.0, None),
    "patisserie": (2, 432, 13.0, None),
    "sandwich": (3, None, None, 60.0),
}
EXCLUDED = ("hot plate", "blue ring", "new gear")
CATCHALL_PREFIX = "small "
REASON_BY_EVENT = {"click": "01", "view": "02", "purchase": "03", "signup": "04", "error": "98"}

CATEGORY_NAMES = {
    category: tuple(
        f"{a} {n}" for n, c in NOUN_CATEGORY.items() if c == category for a in ADJECTIVES
    )
    for category in ("viennoiserie", "patisserie", "sandwich")
}
STANDARDS = tuple(
    (f"{a} {n}", *CATEGORY_STANDARDS[c]) for n, c in NOUN_CATEGORY.items() for a in ADJECTIVES
)
# The inline category table leaves out the "new" products on purpose: an inner
# join to it must drop them.
LISTED_CATEGORIES = tuple(
    (f"{a} {n}", c, "assembled" if c == P.ASSEMBLED_CATEGORY else "baked")
    for n, c in NOUN_CATEGORY.items() for a in ADJECTIVES if a != "new"
)


def table(spark: SparkSession, data: str, name: str) -> DataFrame:
    return spark.read.schema(SOURCE_TABLES[name]).parquet(f"{data}/{name}.parquet")


def _price(retail: Column) -> Column:
    return F.rint(retail * 100) / 100


def _ticket_headers(spark: SparkSession, data: str) -> DataFrame:
    hours = (F.lit(6) + F.col("o_orderkey") % 14).cast("int")
    return table(spark, data, "orders").select(
        "o_orderkey",
        F.to_date("o_orderdate").alias("sale_date"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), hours)).alias("sale_ts"),
    )


def sales_lines(
    spark: SparkSession, data: str, product: bool = True, date: bool = True
) -> DataFrame:
    """Clean sales lines. `product` and `date` say which attributes are needed.

    Attributes are derived on the small side of each join, once for each part
    and order, not for each line.
    """
    lines = table(spark, data, "lineitem")
    columns = [F.col("l_orderkey").alias("ticket_number"), F.col("l_quantity").alias("quantity")]
    if product:
        part = table(spark, data, "part").select(
            "p_partkey",
            F.col("p_name").alias("product"),
            _price(F.col("p_retailprice")).alias("unit_price"),
        )
        lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        columns += [
            F.col("product"),
            F.col("unit_price"),
            money(F.col("l_quantity") * F.col("unit_price")).alias("revenue"),
        ]
    if date:
        orders = _ticket_headers(spark, data)
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        columns += [F.col("sale_date"), F.col("sale_ts")]
    return lines.select(*columns)


def part_sales(spark: SparkSession, data: str) -> DataFrame:
    """Sales by part, for figures by product or price: `lines` says how many lines a row stands for.

    Lines combine map-side by part, sold and returned ones apart, before the part joins: the
    join sees unique keys, and revenue is exact decimal arithmetic on few rows.
    """
    lines = (
        table(spark, data, "lineitem")
        .groupBy("l_partkey", (F.col("l_quantity") > 0).alias("sold"))
        .agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("lines"))
    )
    part = table(spark, data, "part").select(
        "p_partkey", F.col("p_name").alias("product"), _price(F.col("p_retailprice")).alias("unit_price")
    )
    revenue = F.col("quantity").cast("decimal(18,2)") * F.col("unit_price").cast("decimal(14,2)")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey"), "left").select(
        "product", "unit_price", "quantity", "lines", revenue.cast("decimal(32,4)").alias("revenue")
    )


def ticket_sales(spark: SparkSession, data: str, price: bool = True) -> DataFrame:
    """Sales by ticket, for figures that need the date but no product.

    Lines are summed to tickets before the header joins: a ticket's lines, also
    very many, combine before the shuffle, the join reuses that shuffle, and
    both its sides have unique keys.
    """
    lines = sales_lines(spark, data, product=price, date=False).groupBy("ticket_number")
    sums = [F.sum("quantity").alias("quantity")]
    if price:
        sums.append(money(F.sum("revenue")).alias("revenue"))
    orders = _ticket_headers(spark, data)
    return (
        lines.agg(*sums)
        .join(orders, F.col("ticket_number") == F.col("o_orderkey"), "left")
        .drop("o_orderkey")
    )


def raw_sales_lines(
    spark: SparkSession, data: str, product: bool = True, date: bool = True
) -> DataFrame:
    """The same lines as a till export: text price and date, returns, free items.

    `product` and `date` say which attributes are needed; others cost no join.
    """
    lines = table(spark, data, "lineitem")
    returned = F.col("l_returnflag") == "R"
    columns = []
    if date:
        hour = (F.lit(6) + F.col("o_orderkey") % 14).cast("string")
        orders = table(spark, data, "orders").select(
            "o_orderkey",
            F.to_date("o_orderdate").cast("string").alias("date"),
            F.concat(F.lpad(hour, 2, "0"), F.lit(":00")).alias("time"),
        )
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        columns += [F.col("date"), F.col("time")]
    columns.append(F.col("l_orderkey").cast("double").alias("ticket_number"))
    if product:
        price = F.when(F.col("p_size") == 1, F.lit(0.0)).otherwise(_price(F.col("p_retailprice")))
        digits = F.replace(price.cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(","))
        part = table(spark, data, "part").select(
            "p_partkey",
            F.col("p_name").alias("article"),
            F.concat(digits, F.lit(" €")).alias("unit_price"),
        )
        lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        columns.append(F.col("article"))
    columns.append(
        F.when(returned, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("Quantity")
    )
    if product:
        columns.append(F.col("unit_price"))
    return lines.select(*columns)


def _by_noun(name: Column, values: dict) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return pairs[F.substring_index(name, " ", -1)]


def _category(name: Column) -> Column:
    return _by_noun(name, NOUN_CATEGORY)


def _full_load(name: Column) -> Column:
    """Units in a full load; NULL where a product is assembled."""
    loads = {n: CATEGORY_STANDARDS[c][1] for n, c in NOUN_CATEGORY.items()}
    return _by_noun(name, {n: load for n, load in loads.items() if load})


def products(spark: SparkSession, data: str) -> DataFrame:
    """Product master at part grain, as large as the part table."""
    category = _category(F.col("p_name"))
    ratios = F.create_map(
        *[
            x
            for c, r in P.PARAMS.cost_ratio.items()
            for x in (F.lit(c), F.lit(r).cast("decimal(3,2)"))
        ]
    )
    machines = F.create_map(
        *[F.lit(x) for pair in P.PARAMS.category_machines.items() for x in pair]
    )
    return (
        table(spark, data, "part")
        .withColumn("product_category", category)
        .select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            "product_category",
            machines[F.col("product_category")].alias("machine_id"),
            F.round(_price(F.col("p_retailprice")).cast("decimal(12,2)") * ratios[F.col("product_category")], 2)
            .cast("decimal(8,2)").alias("unit_cost_eur"),
            (F.lit(30) + F.col("p_size") * 10).cast("double").alias("ideal_units_per_hr"),
        )
    )


def batches(spark: SparkSession, data: str) -> DataFrame:
    """One production batch for each order with lines.

    Lines are summed by order first, so an order with very many lines is
    combined before the shuffle and both sides of the join have unique keys.
    """
    lines = (
        table(spark, data, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.min("l_partkey").alias("product_id"),
            F.sum("l_quantity").cast("bigint").alias("total_units"),
            F.expr("sum(cast(l_quantity as bigint) * cast(round(l_tax * 100) as bigint)) div 100")
            .alias("scrap_units"),
            F.max("l_discount").cast("decimal(4,2)").alias("stopped_share"),
        )
    )
    orders = table(spark, data, "orders").select("o_orderkey", "o_orderdate")
    parts = table(spark, data, "part").select("p_partkey", "p_name", "p_size")
    loads = F.col("total_units") / _full_load(F.col("p_name"))
    day = F.to_date("o_orderdate")
    ideal = (F.lit(30) + F.col("p_size") * 10).cast("double")
    planned = F.col("planned_production_minutes")
    start = F.col("production_date").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(P.PARAMS.shift_start_hour)
    )
    end = plus_minutes(F.col("scheduled_start_ts"), planned)
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("product_id") == F.col("p_partkey"))
        .withColumn("production_date", F.when(is_sunday(day), F.date_sub(day, 1)).otherwise(day))
        .withColumn(
            "planned_production_minutes",
            F.round(
                F.col("total_units") / ideal * 60 / F.lit(P.PARAMS.planning_efficiency), 2
            ),
        )
        .withColumn("scheduled_start_ts", start)
        .withColumn("scheduled_end_ts", end)
        .select(
            F.concat(F.lit("B"), F.col("l_orderkey")).alias("batch_id"),
            "production_date",
            "product_id",
            (F.lit(1) + F.col("l_orderkey") % 3).cast("int").alias("machine_id"),
            F.col("total_units").alias("planned_units"),
            F.coalesce(half_even(loads, 4), F.lit(0.0)).alias("loads_used"),
            "scheduled_start_ts",
            "scheduled_end_ts",
            "planned_production_minutes",
            F.col("scheduled_start_ts").alias("actual_start_ts"),
            F.col("scheduled_end_ts").alias("actual_end_ts"),
            F.round(planned.cast("decimal(12,2)") * (F.lit(1) - F.col("stopped_share")), 2)
            .cast("double").alias("run_time_minutes"),
            (F.col("total_units") - F.col("scrap_units")).alias("good_units"),
            "scrap_units",
        )
    )


def stops(spark: SparkSession, data: str) -> DataFrame:
    """One stop for each event, on a batch drawn from the whole range of order keys.

    The bound comes from the orders, so stops spread as the orders grow. Orders without
    lines have no batch: their stops are the orphans that the checks report.
    """
    micro = F.col("value") < P.PARAMS.logged_from_minutes
    causes = F.create_map(*[F.lit(x) for pair in REASON_BY_EVENT.items() for x in pair])
    labels = F.create_map(*[F.lit(x) for pair in P.REASON_LABELS.items() for x in pair])
    bound = table(spark, data, "orders").select(F.max("o_orderkey") + 1).scalar()
    order_key = (F.col("event_id") * 7919 + F.col("user_id") * 31) % bound
    miscoded = (
        (F.col("true_reason_code") == P.UNCATEGORISED_CODE)
        | ((F.col("value") < 10) & (F.col("event_id") % 2 == 0))
        | ((F.col("value") < 30) & (F.col("event_id") % 3 == 0))
    )
    rounded = F.greatest(F.lit(5.0), half_even(F.col("value") / 5) * 5)
    return (
        table(spark, data, "events")
        .withColumn(
            "true_reason_code",
            F.when(micro, P.MICRO_STOP_CODE).otherwise(causes[F.col("event_type")]),
        )
        .withColumn(
            "reported_reason_code",
            F.when(miscoded, P.CATCHALL_CODE).otherwise(F.col("true_reason_code")),
        )
        .select(
            F.concat(F.lit("D"), F.col("event_id")).alias("downtime_id"),
            F.concat(F.lit("B"), order_key).alias("batch_id"),
            (F.lit(1) + order_key % 3).cast("int").alias("machine_id"),
            F.to_date("ts").alias("production_date"),
            F.col("ts").alias("start_ts"),
            plus_minutes(F.col("ts"), F.col("value")).alias("end_ts"),
            F.col("value").alias("duration_minutes"),
            F.when(F.col("event_id") % 4 != 0, rounded).otherwise(F.col("value"))
            .alias("reported_duration_minutes"),
            "reported_reason_code",
            labels[F.col("reported_reason_code")].alias("reported_reason_label"),
            "true_reason_code",
            labels[F.col("true_reason_code")].alias("true_reason_label"),
            (~micro).alias("was_logged"),
        )
    )


#: A line of the text export: ticket, article, quantity.
TILL_LINE = T.StructType([
    T.StructField("ticket_number", T.LongType()),
    T.StructField("article", T.StringType()),
    T.StructField("quantity", T.DoubleType()),
])


def till_text(spark: SparkSession, data: str) -> DataFrame:
    """The till lines as text, with the faults a till makes.

    Every 50th ticket (by remainder) has its number printed with a letter, its quantity written
    out, its line cut after the article, or a field too many.
    """
    lines = raw_sales_lines(spark, data, date=False)
    ticket = F.col("ticket_number").cast("bigint")
    rest = ticket % 50
    number = ticket.cast("string")
    article = F.concat(F.lit('"'), F.coalesce("article", F.lit("")), F.lit('"'))
    amount = F.col("Quantity").cast("string")
    text = (
        F.when(rest == 7, F.concat_ws(",", F.concat(F.lit("T"), number), article, amount))
        .when(rest == 11, F.concat_ws(",", number, article, F.lit("two")))
        .when(rest == 13, F.concat_ws(",", number, article))
        .when(rest == 17, F.concat_ws(",", number, article, amount, F.lit("x")))
        .otherwise(F.concat_ws(",", number, article, amount))
    )
    return lines.select(text.alias("value"))
