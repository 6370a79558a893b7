"""Order-dependent totals over a whole table without a one-task window.

A window with no partition keys, or with one very large group, sorts all its
rows in one task. Here rows are first cut into slices that follow the order:
each slice is summed, the few slice sums are accumulated, and the window runs
inside a slice. The result is the same as that of the single window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillfloor.functions.exprs import exact_round, ratio
from tillfloor.session import stage

_EARLIER = (Window.unboundedPreceding, -1)


def total_before(
    df: DataFrame,
    value: str,
    order: Sequence[Column],
    out: str,
    slice_key: Column,
    within: Sequence[str] = (),
) -> DataFrame:
    """Add `out`: the sum of `value` over the rows before this one.

    `order` must be a total order inside a group, and `slice_key` must never
    decrease along it.
    """
    keys = [*within, "_slice"]
    sliced = df.withColumn("_slice", slice_key)
    sums = sliced.groupBy(*keys).agg(F.sum(value).alias("_slice_sum"))
    earlier_slices = Window.partitionBy(*within).orderBy("_slice").rowsBetween(*_EARLIER)
    # A head row carries the total of the earlier slices into its slice, so the
    # rows themselves are shuffled once, for the window, and not for a join.
    heads = sums.select(
        *keys,
        F.lit(0).alias("_row"),
        F.coalesce(F.sum("_slice_sum").over(earlier_slices), F.lit(0)).alias("_add"),
    )
    rows = sliced.withColumns({"_row": F.lit(1), "_add": F.col(value)})
    earlier_rows = Window.partitionBy(*keys).orderBy("_row", *order).rowsBetween(*_EARLIER)
    return (
        rows.unionByName(heads, allowMissingColumns=True)
        .withColumn(out, F.sum("_add").over(earlier_rows))
        .where(F.col("_row") == 1)
        .drop("_slice", "_row", "_add")
    )


def even_blocks(df: DataFrame, order: Sequence[str], out: str = "_block") -> DataFrame:
    """The rows, staged, with a number that never decreases along `order`, equal in near-equal runs of rows.

    Rows are range partitioned by the whole order, so a group with a third of all rows, or a
    burst of them at one moment, is cut wherever a block is full; only rows equal in every
    column of `order` stay together. The numbers are written, hence the same after a retry.
    """
    blocks = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(blocks, *order)
    return stage(ranged.withColumn(out, F.spark_partition_id()))


def _slices(df: DataFrame, key: str, descending: bool) -> Column:
    """Slice number by near-equal row counts, a slice for each shuffle partition.

    The driver holds only the bounds between slices.
    """
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = df.approxQuantile(key, [i / n for i in range(1, n)], 0.5 / n)
    array = F.array(*[F.lit(b) for b in sorted(set(bounds))])
    number = F.size(F.filter(array, lambda b: b < F.col(key).cast("double")))
    return -number if descending else number


def _weight_before(df: DataFrame, key: str, weight: str, out: str, descending: bool) -> DataFrame:
    """`total_before` over the whole of a staged table with one row for each key."""
    order = F.col(key).desc() if descending else F.col(key).asc()
    return total_before(df, weight, [order], out, _slices(df, key, descending))


def global_ranks(df: DataFrame, ranks: dict[str, str]) -> DataFrame:
    """Add a descending rank (ties share it) for each `{new column: value column}`.

    `df` should be staged, since it is read once more for each rank.
    """
    for out, col in ranks.items():
        values = stage(df.groupBy(col).agg(F.count("*").alias("_n")))
        ranked = _weight_before(values, col, "_n", "_above", True)
        ranked = ranked.select(F.col(col).alias("_value"), (F.col("_above") + 1).alias(out))
        df = df.join(ranked, df[col].eqNullSafe(ranked["_value"]), "left").drop("_value")
    return df


def running_share(df: DataFrame, value: str, out: str, digits: int) -> DataFrame:
    """Add the share of the total held by rows with at least this value."""
    totals = df.select(F.sum(value).alias("t")).scalar()
    values = stage(df.groupBy(value).agg(F.sum(value).alias("_weight")))
    above = _weight_before(values, value, "_weight", "_above", True)
    shares = above.select(
        F.col(value).alias("_value"),
        exact_round(ratio(F.col("_above") + F.col("_weight"), totals), digits).alias(out),
    )
    return df.join(shares, df[value].eqNullSafe(shares["_value"]), "left").drop("_value")


def exact_quantiles(df: DataFrame, col: str, probabilities: dict[str, float]) -> DataFrame:
    """One row: row count, mean, sample deviation, min, max and exact quantiles.

    The column is first counted by value, so equal values cost one row, and no
    task ever holds the whole column. Quantiles interpolate between neighbours.
    """
    counts = stage(
        df.where(F.col(col).isNotNull())
        .groupBy(F.col(col).cast("double").alias("_x"))
        .agg(F.count("*").alias("_n"))
    )
    total, mean = counts.agg(
        F.sum("_n"), F.sum(F.col("_x") * F.col("_n")) / F.sum("_n")
    ).first()
    total = total or 0
    before = _weight_before(counts, "_x", "_n", "_before", False)

    def at(position: int) -> Column:
        hit = (F.col("_before") <= position) & (F.col("_before") + F.col("_n") > position)
        return F.max(F.when(hit, F.col("_x")))

    def quantile(p: float) -> Column:
        place = (total - 1) * p if total else 0.0
        low = int(place)
        high = low + 1 if place > low else low
        return at(low) + (at(high) - at(low)) * (place - low)

    square = F.sum((F.col("_x") - F.lit(mean)) * (F.col("_x") - F.lit(mean)) * F.col("_n"))
    return before.agg(
        F.lit(total).cast("bigint").alias("count"),
        F.lit(mean).cast("double").alias("mean"),
        F.sqrt(F.try_divide(square, F.lit(float(total - 1)))).alias("std"),
        F.min("_x").alias("min"),
        *[quantile(p).alias(name) for name, p in probabilities.items()],
        F.max("_x").alias("max"),
    )
