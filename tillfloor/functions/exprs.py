"""Column expressions shared by the operators. All are built-in, none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_round(col: Column, digits: int) -> Column:
    """Round half up, as a double, after eight decimals have dropped the noise of a quotient.

    Sums that go in are exact (`money_sum`, `minutes_sum`, counts), so the answer is
    the same at any partitioning; a plain sum of doubles would not be.
    """
    return F.round(col.cast("decimal(28,8)"), digits).cast("double")


_TICKS = 10_000


def _ticks(amount: Column) -> Column:
    return F.rint(amount * _TICKS).cast("bigint")


def money(amount: Column) -> Column:
    """An amount as the double nearest to its value at four decimals."""
    return F.rint(amount * _TICKS) / _TICKS


def money_sum(amount: Column) -> Column:
    """Exact total, as a decimal, of amounts with at most four decimals.

    Whole units and the rest are summed as integers: the result does not depend
    on the order of the rows, no row touches decimal arithmetic, and neither
    sum overflows below 9e18 units or 9e14 rows.
    """
    ticks = _ticks(amount)
    rest = ticks % _TICKS
    whole = F.call_function("div", ticks - rest, F.lit(_TICKS))
    return F.sum(whole).cast("decimal(32,4)") + (
        F.sum(rest).cast("decimal(20,0)") * F.lit("0.0001").cast("decimal(4,4)")
    )


def minutes_sum(minutes: Column) -> Column:
    """Exact total of durations with at most four decimals, by the same integer sums."""
    return money_sum(minutes)


def hours_sum(hours: Column) -> Column:
    """Total of earned hours, each to eight decimals, the same in any order of the rows."""
    return F.sum(hours.cast("decimal(18,8)"))


def line_count(df) -> Column:
    """How many lines the rows stand for: rows summed by part bring their `lines`."""
    return F.sum("lines") if "lines" in df.columns else F.count("*")


def revenue_sum(df) -> Column:
    """Exact revenue, of doubles or of decimals that are exact already."""
    if df.schema["revenue"].dataType.typeName() == "decimal":
        return F.sum("revenue").cast("decimal(38,4)")
    return money_sum(F.col("revenue"))


def money_round(col: Column, digits: int = 2) -> Column:
    """Round a decimal amount half up; the amount itself is exact."""
    return F.round(col, digits).cast("double")


def half_even(col: Column, digits: int = 0) -> Column:
    return F.bround(col, digits) if digits else F.rint(col)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, NULL where the denominator is zero or NULL."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def day_name(date: Column) -> Column:
    return F.date_format(date, "EEEE")


def month_start(date: Column) -> Column:
    return F.trunc(date, "MM")


def is_sunday(date: Column) -> Column:
    return F.dayofweek(date) == 1


def plus_minutes(ts: Column, minutes: Column) -> Column:
    """Timestamp plus a double number of minutes, to the millisecond."""
    seconds = F.round(minutes * 60, 3).cast("decimal(18,6)")
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def batch_key(date: Column, product_id: Column, seq: Column) -> Column:
    """'B' and twelve hex digits of the md5 of yyyymmdd-product-sequence."""
    raw = F.concat_ws(
        "-", F.date_format(date, "yyyyMMdd"), product_id.cast("string"), seq.cast("string")
    )
    return F.concat(F.lit("B"), F.substring(F.md5(raw), 1, 12))


def md5_fraction(key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone, for repeatable samples."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / F.lit(float(2**32))
