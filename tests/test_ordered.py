"""Sliced totals against one plain window, with a hot group and with NULL keys."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillfloor.functions import exact_quantiles, global_ranks
from tillfloor.functions.ordered import even_blocks, running_share, total_before
from tillfloor.session import stage


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(6000):
        group = "hot" if i % 3 == 0 else (None if i % 97 == 0 else f"g{rng.randrange(40)}")
        data.append((i, group, rng.randrange(1000), rng.randrange(50)))
    return spark.createDataFrame(data, "id int, grp string, at int, v int").repartition(8)


def test_total_before_equals_one_window(rows):
    order = [F.col("at"), F.col("id")]
    got = total_before(rows, "v", order, "before", F.floor(F.col("at") / 100), within=["grp"])
    one = Window.partitionBy("grp").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    want = rows.withColumn("before", F.coalesce(F.sum("v").over(one), F.lit(0)))
    assert got.columns == want.columns
    assert sorted(map(tuple, got.select("id", "before").collect())) == sorted(
        map(tuple, want.select("id", "before").collect())
    )


def _plain_ranks(df, col):
    """Rank by sorting the whole column on the driver of the test."""
    values = sorted((r[col] for r in df.collect() if r[col] is not None), reverse=True)
    first: dict = {}
    for i, v in enumerate(values):
        first.setdefault(v, i + 1)
    first[None] = len(values) + 1
    return first


@pytest.mark.parametrize("partitions", ["2", "8", "400"])
def test_ranks_equal_a_plain_sort(spark, rows, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    staged = stage(rows.select("id", "at", "v"))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = global_ranks(staged, {"r_at": "at", "r_v": "v"}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    at, v = _plain_ranks(staged, "at"), _plain_ranks(staged, "v")
    assert len(got) == 6000
    assert all(r.r_at == at[r["at"]] and r.r_v == v[r["v"]] for r in got)


def test_running_share_equals_a_plain_sum(rows):
    staged = stage(rows.groupBy("at").agg(F.sum("v").cast("double").alias("v")))
    got = running_share(staged, "v", "share", 4).collect()
    values = [r.v for r in got]
    for r in got:
        assert r.share == pytest.approx(sum(x for x in values if x >= r.v) / sum(values), abs=6e-5)
    assert max(r.share for r in got) == 1.0


def test_ranks_of_a_decimal_with_nulls(rows):
    amount = F.when(F.col("v") > 2, F.col("at").cast("decimal(38,4)"))
    staged = stage(rows.select("id", amount.alias("amount")))
    want = _plain_ranks(staged, "amount")
    got = global_ranks(staged, {"r": "amount"}).collect()
    assert len(got) == 6000 and all(r.r == want[r.amount] for r in got)


def test_quantiles_are_exact(rows):
    values = sorted(r.at for r in rows.collect())
    got = exact_quantiles(rows, "at", {"q25": 0.25, "q50": 0.5, "q75": 0.75}).first()
    want = statistics.quantiles(values, n=4, method="inclusive")
    assert [got.q25, got.q50, got.q75] == want
    assert got["count"] == len(values) and got["max"] == values[-1]
    assert got["mean"] == pytest.approx(statistics.mean(values))
    assert got["std"] == pytest.approx(statistics.stdev(values))


def test_a_burst_in_one_group_spreads_over_blocks(spark):
    rows = spark.range(4000).select(F.lit("hot").alias("grp"), F.lit(7).alias("at"), "id", F.lit(1).alias("v"))
    blocks = even_blocks(rows, ["grp", "at", "id"], "block")
    sizes = [r["count"] for r in blocks.groupBy("block").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 1500
    got = total_before(blocks, "v", [F.col("at"), F.col("id")], "before", F.col("block"), within=["grp"])
    assert got.where("before is distinct from nullif(id, 0)").where("id > 0 or before is not null and before <> 0").count() == 0
