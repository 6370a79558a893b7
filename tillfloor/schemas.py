"""Declared schemas. Loads never infer types; sinks write columns in this order."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, INT, LONG, REAL = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
DATE, TIME, FLAG = T.DateType(), T.TimestampNTZType(), T.BooleanType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# The Parquet tables that stand in for a till export and a plant's event log. A
# declared schema also spares a job that would read file footers to infer one.
SOURCE_TABLES = {
    "lineitem": _struct(
        l_orderkey=LONG, l_partkey=LONG, l_suppkey=LONG, l_linenumber=INT, l_quantity=REAL,
        l_extendedprice=REAL, l_discount=REAL, l_tax=REAL, l_returnflag=TEXT,
        l_linestatus=TEXT, l_shipdate=TIME,
    ),
    "orders": _struct(
        o_orderkey=LONG, o_custkey=LONG, o_orderstatus=TEXT, o_totalprice=REAL,
        o_orderdate=TIME, o_orderpriority=TEXT,
    ),
    "part": _struct(
        p_partkey=LONG, p_name=TEXT, p_brand=TEXT, p_type=TEXT, p_size=INT, p_retailprice=REAL,
    ),
    "events": _struct(
        event_id=LONG, ts=TIME, user_id=LONG, event_type=TEXT, value=REAL, props=TEXT,
    ),
}

RAW_SALES = _struct(**{
    "Unnamed: 0": TEXT, "date": TEXT, "time": TEXT, "ticket_number": REAL, "article": TEXT,
    "Quantity": REAL, "unit_price": TEXT,
})

CLEAN_SALES = _struct(
    date=TEXT, time=TEXT, datetime=TIME, ticket_number=LONG, article=TEXT, Quantity=REAL,
    unit_price=REAL, revenue=REAL,
)

DIM_PRODUCT = _struct(
    product_id=INT, product_name=TEXT, product_category=TEXT, process_type=TEXT,
    machine_id=INT, units_per_full_load=INT, bake_minutes=REAL,
    unit_cost_eur=T.DecimalType(8, 2), ideal_units_per_hr=REAL, v1_total_units=LONG,
)

DIM_MACHINE = _struct(
    machine_id=INT, machine_name=TEXT, machine_type=TEXT, install_year=INT,
    capacity_units=TEXT, full_load_reference=TEXT, handling_minutes=REAL,
    base_failure_rate_per_hr=REAL,
)

STANDARDS = _struct(
    product_name=TEXT, machine_id=INT, units_per_full_load=INT, bake_minutes=REAL,
    assembly_seconds=REAL,
)

CATEGORIES = _struct(product_name=TEXT, product_category=TEXT, process_type=TEXT)

WEEKDAYS = _struct(weekday_no=INT, day_of_week=TEXT)

REASONS = _struct(reason_code=TEXT, reason_label=TEXT)

FACT_BATCH = _struct(
    batch_id=TEXT, production_date=DATE, product_id=LONG, machine_id=INT, planned_units=LONG,
    loads_used=REAL, scheduled_start_ts=TIME, scheduled_end_ts=TIME,
    planned_production_minutes=REAL, actual_start_ts=TIME, actual_end_ts=TIME,
    run_time_minutes=REAL, good_units=LONG, scrap_units=LONG,
)

FACT_DOWNTIME = _struct(
    downtime_id=TEXT, batch_id=TEXT, machine_id=INT, production_date=DATE, start_ts=TIME,
    end_ts=TIME, duration_minutes=REAL, reported_duration_minutes=REAL,
    reported_reason_code=TEXT, reported_reason_label=TEXT, true_reason_code=TEXT,
    true_reason_label=TEXT, was_logged=FLAG,
)

FACT_INSPECTION = _struct(
    inspection_id=TEXT, batch_id=TEXT, production_date=DATE, inspection_ts=TIME,
    sample_size=INT, defects_found=INT, outcome=TEXT, defect_type=TEXT,
)

STAR_TABLES = {
    "dim_product": DIM_PRODUCT,
    "dim_machine": DIM_MACHINE,
    "fact_production_batch": FACT_BATCH,
    "fact_downtime": FACT_DOWNTIME,
    "fact_quality_inspection": FACT_INSPECTION,
}

# Sort keys inside each date partition, so Parquet min/max statistics prune.
CLUSTER_KEYS = {
    "fact_production_batch": ["machine_id", "product_id"],
    "fact_downtime": ["machine_id", "reported_reason_code"],
    "fact_quality_inspection": ["outcome"],
}
