"""CSV scans with declared types. Names may hold commas, so the quote is set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tillfloor import schemas


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_raw_sales(spark: SparkSession, path: str) -> DataFrame:
    """The till export as it comes: text prices and a leading index column."""
    return _read(spark, path, schemas.RAW_SALES)


def read_clean_sales(spark: SparkSession, path: str) -> DataFrame:
    """The cleaned sales file, with its timestamp column parsed."""
    return _read(spark, path, schemas.CLEAN_SALES)


def load_fact(spark: SparkSession, table: str, csv_path: str, target: str) -> int:
    """Replace a fact table by a CSV file of its declared schema; return its rows."""
    from tillfloor.sources.sinks import write_fact

    write_fact(_read(spark, csv_path, schemas.STAR_TABLES[table]), table, target)
    return spark.read.parquet(target).count()
