"""Duplicates by digest and profiles that merge, against plain counts."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from tillfloor.operators import profile

KIND = "a string, b string, x double, day string"


def _rows(n):
    pick = random.Random(5)
    return [
        (pick.choice(["p", "q", None]), pick.choice(["p", None, ""]), pick.choice([0.0, -0.0, 1.5, float("nan"), None]),
         pick.choice(["2021-01", "2021-02", None]))
        for _ in range(n)
    ]


def test_duplicates_are_exact(spark):
    # NULL and a value that change places are no copies; -0.0 equals 0.0 and NaN equals NaN.
    rows = [("p", None, 1.0, "d"), (None, "p", 1.0, "d"), (None, "p", 1.0, "d"), ("x", "", 0.0, "d"),
            ("x", "", -0.0, "d"), ("y", "", float("nan"), None), ("y", "", float("nan"), None)]
    assert profile.duplicates(spark.createDataFrame(rows, KIND)).first()[0] == 3
    assert profile.duplicates(spark.createDataFrame([], KIND)).first()[0] == 0


def test_rows_with_meeting_digests_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(profile, "_digest", lambda df: [F.lit(1), F.lit(2)])
    df = spark.createDataFrame([("p", None, 1.0, "d"), ("q", None, 1.0, "d"), ("q", None, 1.0, "d")], KIND)
    assert profile.duplicates(df).first()[0] == 1


def test_rows_without_a_copy_are_shuffled_as_digests(spark):
    df = spark.range(0, 1000, 1, 4).select(F.col("id"), F.md5(F.col("id").cast("string")).alias("text"))
    plan = profile.duplicates(df)._jdf.queryExecution().executedPlan().toString()
    first = next(line for line in plan.splitlines() if "partial_count(1)" in line and "digest_a_" in line)
    assert "text" not in first.split("Output")[0].split("output=")[-1]
    assert profile.duplicates(df).first()[0] == 0


def test_two_halves_merge_to_the_profile_of_the_whole(spark):
    rows = _rows(400)
    day = F.col("day")
    parts = [profile.partial_profile(spark.createDataFrame(half, KIND), day) for half in (rows[:150], rows[150:])]
    whole = profile.finish_profile(profile.merge_profiles(profile.partial_profile(spark.createDataFrame(rows, KIND), day)))
    merged = profile.finish_profile(profile.merge_profiles(*parts))
    assert sorted(merged.collect()) == sorted(whole.collect())
    got = {r.column_name: r for r in merged.collect()}
    for at, name in [(0, "a"), (1, "b"), (3, "day")]:
        values = Counter(r[at] for r in rows)
        nulls = values.pop(None, 0)
        top = min(values, key=lambda v: (-values[v], v))
        assert tuple(got[name])[1:] == (400, nulls, len(values), values[top], top)


def test_empty_table_and_empty_columns(spark):
    empty = profile.partial_profile(spark.createDataFrame([], KIND), F.col("day"))
    assert profile.finish_profile(profile.merge_profiles(empty)).count() == 0
    nulls = profile.partial_profile(spark.createDataFrame([(None, None, None, None)], KIND), F.col("day"))
    got = profile.finish_profile(profile.merge_profiles(nulls, nulls)).collect()
    assert {tuple(r)[1:] for r in got} == {(2, 2, 0, None, None)}
