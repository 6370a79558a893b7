"""Sinks: tables replaced, appended, partitioned by date, exported, published."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillfloor import schemas


def replace_table(df: DataFrame, path: str) -> None:
    """Create or replace a folder from a query. Static overwrite drops all old rows first, so
    a failed write loses them: what readers depend on goes through `publish_if_valid`."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def write_fact(df: DataFrame, table: str, path: str, mode: str = "overwrite") -> None:
    """Write a fact by production date, sorted by its cluster keys.

    Declared columns that `df` has not yet are written as NULL. Rows are shuffled by date and first cluster key, and AQE splits a date that
    grows too large, so one busy date is no single task and files stay few.
    """
    keys = schemas.CLUSTER_KEYS[table]
    declared = schemas.STAR_TABLES[table]
    ordered = add_missing_columns(df, declared).select(*declared.names)
    (
        ordered.hint("rebalance", "production_date", keys[0])
        .sortWithinPartitions("production_date", *keys)
        .write.mode(mode)
        .option("partitionOverwriteMode", "static")
        .partitionBy("production_date")
        .parquet(path)
    )


def append_by_position(df: DataFrame, table: str, path: str) -> None:
    """Insert-select: the columns of `df` map to the declared ones by position."""
    schema = schemas.STAR_TABLES[table]
    if len(df.columns) != len(schema):
        raise ValueError(f"{table} has {len(schema)} columns, the query {len(df.columns)}")
    mapped = df.toDF(*schema.names).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]
    )
    write_fact(mapped, table, path, mode="append")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option(
        "escape", '"'
    ).csv(path)


def add_missing_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add declared columns that a table does not have yet, as NULLs."""
    return df.withColumns(
        {f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns}
    )


def read_fact(spark: SparkSession, table: str, path: str) -> DataFrame:
    """A stored fact in its declared columns, whatever columns its files were written with.

    The files' schemas are merged first: a column that some or all files lack is NULL there, one
    that is stored with another type or that is not declared raises.
    """
    declared = schemas.STAR_TABLES[table]
    merged = spark.read.option("mergeSchema", True).parquet(path).schema
    kinds = {f.name: f.dataType for f in declared}
    wrong = [
        f"{f.name} {f.dataType.simpleString()}" for f in merged
        if f.name != "production_date" and kinds.get(f.name) != f.dataType
    ]
    if wrong:
        raise ValueError(f"{table} does not declare {', '.join(wrong)}")
    return spark.read.schema(declared).parquet(path).select(*declared.names)


# --- versions: nothing that can be read is ever overwritten

POINTER = T.StructType([T.StructField("number", T.LongType()), T.StructField("version", T.StringType())])


def new_version() -> str:
    return f"v-{uuid.uuid4().hex}"


def current_version(spark: SparkSession, path: str) -> str | None:
    """The version that was committed last, or None where none was."""
    try:
        log = spark.read.schema(POINTER).parquet(f"{path}/versions")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    row = log.orderBy(F.desc("number"), "version").first()
    return row and row.version


def commit_version(spark: SparkSession, path: str, version: str) -> None:
    """Make a complete version the current one: one row more in a small log.

    The row's file appears whole or not at all, so readers see the old version
    or the new one. Old versions stay until their owner removes them.
    """
    numbers = 0
    if current_version(spark, path) is not None:
        log = spark.read.schema(POINTER).parquet(f"{path}/versions")
        numbers = log.agg(F.max("number")).first()[0]
    row = spark.createDataFrame([(numbers + 1, version)], POINTER)
    row.coalesce(1).write.mode("append").parquet(f"{path}/versions")


def published(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a published table."""
    version = current_version(spark, path)
    if version is None:
        raise LookupError(f"nothing is published at {path}")
    return spark.read.parquet(f"{path}/{version}")


def publish_if_valid(
    df: DataFrame, path: str, checks: Callable[[DataFrame], DataFrame] | None = None
) -> None:
    """Write a new version, check what was written, and only then make it the current one.

    A failed write or check raises; readers go on with the version they had.
    """
    from tillfloor.operators.checks import require_passed

    version = new_version()
    df.write.parquet(f"{path}/{version}")
    if checks is not None:
        require_passed(checks(df.sparkSession.read.parquet(f"{path}/{version}")))
    commit_version(df.sparkSession, path, version)
