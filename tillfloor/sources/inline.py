"""Constant tables: a handful of rows held in the plan itself."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tillfloor import params as P
from tillfloor import schemas


def inline_table(spark: SparkSession, rows: Iterable[tuple], schema: T.StructType) -> DataFrame:
    """Rows as a local relation: no Python worker, and a size that Spark knows."""
    arrow = to_arrow_schema(schema)
    columns = zip(*rows, strict=True)
    arrays = [pa.array(values, type=f.type) for values, f in zip(columns, arrow, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema)


def machine_table(spark: SparkSession, rows: Iterable[tuple] = P.MACHINES) -> DataFrame:
    return inline_table(spark, rows, schemas.DIM_MACHINE)


def standards_table(
    spark: SparkSession, rows: Iterable[tuple] = P.OPERATING_STANDARDS
) -> DataFrame:
    return inline_table(spark, rows, schemas.STANDARDS)


def category_table(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    return inline_table(spark, rows, schemas.CATEGORIES)


def weekday_table(spark: SparkSession) -> DataFrame:
    """The seven weekdays in order."""
    return inline_table(spark, enumerate(P.WEEKDAYS, start=1), schemas.WEEKDAYS)


def reason_table(spark: SparkSession) -> DataFrame:
    return inline_table(spark, P.REASON_LABELS.items(), schemas.REASONS)
