"""The star as bucketed catalog tables: batches, stops and inspections meet by batch without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillfloor.functions import exact_round, minutes_sum
from tillfloor.session import staging_folder

#: Tables that carry the batch key, and are bucketed and sorted by it.
BY_BATCH = ("fact_production_batch", "fact_downtime", "fact_quality_inspection")


def save_star(
    tables: dict[str, DataFrame], prefix: str, folder: str, buckets: int
) -> dict[str, DataFrame]:
    """Save the star as catalog tables `prefix + name` in `folder`; return them as stored.

    Facts have the same number of buckets of `batch_id`, one sorted file each, since rows are
    hashed to as many tasks first. All rows of one batch lie in one bucket: a batch is the
    unit of production and its stops are bounded by its length.
    """
    stored = {}
    for name, df in tables.items():
        writer = df.write
        if name in BY_BATCH:
            hashed = df.repartition(buckets, "batch_id")
            writer = hashed.write.bucketBy(buckets, "batch_id").sortBy("batch_id")
        writer.option("path", f"{folder}/{name}").saveAsTable(prefix + name)
        stored[name] = df.sparkSession.table(prefix + name)
    return stored


def staged_star(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The star saved under names of its own in the staging folder of the application."""
    spark = next(iter(tables.values())).sparkSession
    mark = uuid.uuid4().hex
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return save_star(tables, f"star_{mark}_", f"{staging_folder(spark)}/star-{mark}", buckets)


def batch_history(stored: dict[str, DataFrame]) -> DataFrame:
    """Each batch with its product, its stops and its inspection, joined bucket by bucket.

    The product is looked up in the registered `dim_product`, after the joins by batch.
    """
    stops = stored["fact_downtime"].groupBy("batch_id").agg(
        F.count("*").alias("stops"),
        exact_round(minutes_sum(F.col("duration_minutes")), 2).alias("stop_minutes"),
        F.count_if("was_logged").alias("logged_stops"),
    )
    seen = stored["fact_quality_inspection"].groupBy("batch_id").agg(
        F.count("*").alias("inspections"), F.count_if(F.col("outcome") == "FAIL").alias("failed")
    )
    batches = stored["fact_production_batch"].select(
        "batch_id", "product_id", "good_units", "scrap_units"
    )
    names = stored["dim_product"].select("product_id", "product_name")
    joined = batches.join(stops, "batch_id", "left").join(seen, "batch_id", "left")
    return joined.join(names, "product_id", "left").select(
        "batch_id", "product_name", "good_units", "scrap_units",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("stops", "logged_stops", "inspections", "failed")],
        F.coalesce("stop_minutes", F.lit(0.0)).alias("stop_minutes"),
    )
