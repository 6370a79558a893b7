"""Facts that are reloaded by date: new files first, then a small log that says which count.

Layout: `data/version=.../production_date=...` holds rows, `dates` one row for each date of each
load. A reader takes, of every date, the files of its latest load. Nothing readable is overwritten,
so a load that fails leaves every date as it was, and the files of other dates are not touched.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillfloor import schemas
from tillfloor.sources.sinks import new_version

LOG = T.StructType([
    T.StructField("number", T.LongType()),
    T.StructField("production_date", T.DateType()),
    T.StructField("version", T.StringType()),
])


def _log(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LOG).parquet(f"{path}/dates")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def current_dates(spark: SparkSession, path: str) -> DataFrame:
    """(production_date, version) of the dates that hold rows: one row for each date."""
    last = F.max_by("version", "number").alias("version")
    return _log(spark, path).groupBy("production_date").agg(last).where("version is not null")


def reload_dates(df: DataFrame, table: str, path: str, emptied: Iterable[date] = ()) -> None:
    """Replace the dates that `df` holds; `emptied` names dates that are left without rows.

    The dates of one load become current together. A row without a date fails the load.
    """
    spark = df.sparkSession
    keys = schemas.CLUSTER_KEYS[table]
    version = new_version()
    day = F.coalesce("production_date", F.raise_error(F.lit("a row has no production date")).cast("date"))
    (
        df.select(*schemas.STAR_TABLES[table].names)
        .withColumns({"production_date": day, "version": F.lit(version)})
        .hint("rebalance", "production_date", keys[0])
        .sortWithinPartitions("production_date", *keys)
        .write.mode("append")
        .partitionBy("version", "production_date")
        .parquet(f"{path}/data")
    )
    number = (_log(spark, path).agg(F.max("number")).first()[0] or 0) + 1
    loaded = (
        _stored(spark, table, path, [f"{path}/data"]).where(F.col("version") == version)
        .select("production_date", "version").distinct()
    )
    gone = spark.createDataFrame([(d, None) for d in emptied], T.StructType(LOG.fields[1:]))
    gone = gone.join(loaded, "production_date", "left_anti")
    entries = loaded.union(gone).select(F.lit(number).cast("long").alias("number"), "production_date", "version")
    entries.coalesce(1).write.mode("append").parquet(f"{path}/dates")


def _stored(spark: SparkSession, table: str, path: str, folders: list[str]) -> DataFrame:
    kinds = T.StructType([*schemas.STAR_TABLES[table].fields, LOG["version"]])
    return spark.read.schema(kinds).option("basePath", f"{path}/data").parquet(*folders)


def read_dated(spark: SparkSession, table: str, path: str) -> DataFrame:
    """The current rows of every date. Only folders of current loads are listed (one name a date)."""
    names = schemas.STAR_TABLES[table].names
    now = current_dates(spark, path).collect()
    if not now:
        return spark.createDataFrame([], schemas.STAR_TABLES[table])
    folders = sorted(
        f"{path}/data/version={r.version}/production_date={r.production_date}" for r in now
    )
    return _stored(spark, table, path, folders).select(*names)
