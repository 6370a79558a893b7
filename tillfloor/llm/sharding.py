"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0 to n - 1 in the order of the given columns: ranges of that order are sorted
apart, written once, and each range begins where the counts of those before it end. The numbers are
then permuted by a Feistel network over a x b cells, a * b just above n, with cycle walking:
a number sent past n - 1 is sent again until it lands below. The permuted number p gives
shard p mod shards and slot p div shards, so counts differ by one at most, slots have no gaps,
and shard and slot of a row number can be computed without the table (`place`).

Rows equal in all ordering columns are interchangeable. Null ids come first. A null text has no
bytes. An empty table gives an empty result. Input columns named like a result are
replaced. No Python touches a row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillfloor.llm.common import stage

# The round function, modulo the prime 2^31 - 1.
PRIME = 2147483647
ROUNDS = ((1103515245, 12345), (1664525, 1013904223), (69069, 362437), (134775813, 907633385))


def cells(n: int) -> tuple[int, int]:
    """a and b of the network for n numbers: a is the root of n, a * b - n is below a."""
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def noise(half: int, turn: int) -> int:
    m, add = ROUNDS[turn % len(ROUNDS)]
    x = (half % PRIME * m + add + turn) % PRIME
    return (x * x + add) % PRIME


def permuted(x: int, n: int) -> int:
    """The place of row number x in the shuffle of n rows, in plain Python."""
    a, b = cells(n)
    while True:
        left, right = x // b, x % b
        for turn in range(len(ROUNDS)):
            if turn % 2:
                right = (right + noise(left, turn)) % b
            else:
                left = (left + noise(right, turn)) % a
        x = left * b + right
        if x < n:
            return x


def place(row: int, n: int, shards: int) -> tuple[int, int]:
    p = permuted(row, n)
    return p % shards, p // shards


def permutation(row: str, n: int) -> str:
    """SQL of the permuted number of column `row`, with the walk for numbers sent past n - 1.

    A walk visits each of the a * b - n cells past the end once at most, which bounds it exactly;
    the list of steps is made only for the few rows that need it.
    """
    a, b = cells(n)

    def once(x: str) -> str:
        # each half is a let-binding, so that no expression is repeated
        out = f"named_struct('l', {x} div {b}L, 'r', {x} % {b}L)"
        for turn, (m, add) in enumerate(ROUNDS):
            half, other, size = ("l", "r", a) if turn % 2 == 0 else ("r", "l", b)
            base = f"((s.{other} % {PRIME}L * {m}L + {add + turn}L) % {PRIME}L)"
            new = f"(s.{half} + ({base} * {base} + {add}L) % {PRIME}L) % {size}L"
            fields = {half: new, other: f"s.{other}"}
            out = f"transform(array({out}), s -> named_struct('l', {fields['l']}, 'r', {fields['r']}))[0]"
        return f"transform(array({out}), s -> s.l * {b}L + s.r)[0]"

    past = a * b - n
    if not past:
        return once(row)
    walk = f"aggregate(sequence(1, {past}), y, (v, i) -> if(v < {n}L, v, {once('v')}))"
    return f"transform(array({once(row)}), y -> if(y < {n}L, y, {walk}))[0]"


def numbered(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """The rows with their global number `row_number_`, and how many there are.

    The sorted ranges are written once, so that number and row can never come from two
    different sorts, also after the loss of an executor.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    kept = stage(sorted_.withColumns({"part_": F.shiftright(at, 33), "at_": at.bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = kept.groupBy("part_").count()
    # as many rows as there are ranges
    before = F.coalesce(
        F.sum("count").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = stage(counts.select("part_", before.alias("before_"), "count"))
    n = offsets.agg(F.sum("count")).first()[0] or 0
    rows = kept.join(offsets.drop("count"), "part_").withColumn("row_number_", F.col("before_") + F.col("at_"))
    return rows.drop("part_", "at_", "before_"), n


def shard(df: DataFrame, order: list[str], shards: int = 24) -> DataFrame:
    """df with shard (int) and slot (long) of every row."""
    rows, n = numbered(df.drop("shard", "slot"), order)
    p = F.expr(permutation("row_number_", max(n, 1)))
    return rows.withColumn("place_", p).withColumns(
        {"shard": (F.col("place_") % shards).cast("int"), "slot": F.expr(f"place_ div {shards}")}
    ).drop("row_number_", "place_")
