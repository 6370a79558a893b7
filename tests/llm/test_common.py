from __future__ import annotations

from tillfloor.llm.common import likely


def test_a_filter_keeps_every_key_and_little_else(spark):
    rows = spark.range(-5, 20_000).selectExpr("id AS k", "cast(id AS string) AS v")
    keys = spark.range(0, 20_000, 40).selectExpr("id AS other")
    got = likely(rows, "k", keys)
    found = [r.k for r in got.collect()]
    assert got.columns == ["k", "v"] and set(range(0, 20_000, 40)) <= set(found) and len(found) == len(set(found)) < 520
    assert likely(rows, "k", keys.limit(0)).count() == 0
