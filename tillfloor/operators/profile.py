"""Profiling of a raw table: each operator is one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillfloor.functions import exact_quantiles, exact_round

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def shape(df: DataFrame, columns: int | None = None) -> DataFrame:
    """Rows and columns. A table whose attributes are joined in is counted without them."""
    return df.agg(F.count("*").alias("row_count")).withColumn(
        "column_count", F.lit(len(df.columns) if columns is None else columns)
    )


def peek(df: DataFrame, rows: int = 5) -> DataFrame:
    return df.limit(rows)


def column_types(df: DataFrame) -> list[tuple[str, str]]:
    return df.dtypes


def nulls(df: DataFrame) -> DataFrame:
    """NULLs of every column: one aggregate row, turned to one row for each column."""
    counted = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return counted.unpivot([], df.columns, "column_name", "nulls")


def _digest(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a row; they differ in their start, and both tell which columns are NULL."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    missing = [c.isNull() for c in columns]
    return [
        F.xxhash64(*columns, *missing).alias("digest_a_"),
        F.xxhash64(F.lit(1), *missing, *columns).alias("digest_b_"),
    ]


def duplicates(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row, NULLs being equal.

    Rows meet by 16 bytes of digest. Only those whose digest meets another are then grouped by
    all their columns, so the count is exact and rows without a copy are never shuffled whole.
    """
    tagged = df.withColumns({f"digest_{n}_": c for n, c in zip("ab", _digest(df))})
    keys = ["digest_a_", "digest_b_"]
    met = tagged.groupBy(*keys).count().where("count > 1").select(*keys)
    rows = tagged.join(met, keys, "left_semi").groupBy(*[f"`{c}`" for c in df.columns]).count()
    return rows.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))


def partial_profile(df: DataFrame, part: Column) -> DataFrame:
    """Lines of every value of every column, by part: (part, column_name, value, lines).

    Parts computed apart (days as they arrive) merge to the exact profile of all of them. Values
    are text; NULL is a value of its own. A frequent value combines before the shuffle.
    """
    texts = df.select(part.alias("part"), *[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    long = texts.unpivot(["part"], [f"`{c}`" for c in df.columns], "column_name", "value")
    return long.groupBy("part", "column_name", "value").agg(F.count("*").alias("lines"))


def merge_profiles(*profiles: DataFrame) -> DataFrame:
    """One histogram of all parts of several partial profiles; a part may stand in more than one."""
    every = reduce(DataFrame.unionByName, profiles)
    return every.groupBy("column_name", "value").agg(F.sum("lines").alias("lines"))


def finish_profile(histogram: DataFrame) -> DataFrame:
    """Rows, NULLs, distinct values and the most frequent value (of equal ones the least) by column."""
    value, lines = F.col("value"), F.col("lines")
    top = F.max(F.when(value.isNotNull(), lines))
    by_column = histogram.groupBy("column_name").agg(
        F.sum("lines").alias("row_count"),
        F.coalesce(F.sum(F.when(value.isNull(), lines)), F.lit(0)).alias("nulls"),
        F.count("value").alias("distinct_values"),
        top.alias("top_lines"),
        F.min_by("value", F.when(value.isNotNull(), F.struct(-lines, value))).alias("top_value"),
    )
    return by_column


def value_range(
    df: DataFrame, date: str, name: str, quantity: Column, zero_price: Column
) -> DataFrame:
    """Date range, unreadable dates, distinct names, negative quantities and zero prices."""
    day = F.col(date).try_cast("date")
    by_name = df.groupBy(name).agg(
        F.min(day).alias("first"),
        F.max(day).alias("last"),
        F.count_if(F.col(date).isNotNull() & day.isNull()).alias("unreadable"),
        F.count_if(quantity < 0).alias("negative"),
        F.count_if(zero_price).alias("free"),
    )
    return by_name.agg(
        F.min("first").alias("min_date"),
        F.max("last").alias("max_date"),
        F.sum("unreadable").alias("unreadable_dates"),
        F.count(name).alias("products"),
        F.sum("negative").alias("negative_quantities"),
        F.sum("free").alias("zero_prices"),
    )


def rare_values(df: DataFrame, name: str, rows: int = 20) -> DataFrame:
    counted = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))
    return counted.orderBy("n", name).limit(rows)


def describe(df: DataFrame, col: str) -> DataFrame:
    """Count, mean, deviation, minimum, exact quartiles and maximum of a column."""
    row = exact_quantiles(df, col, QUARTILES)
    numbers = [c for c in row.columns if c != "count"]
    return row.select("count", *[exact_round(F.col(c), 4).alias(c) for c in numbers])
