"""Rejects set apart, reload by date, stored schemas that changed, the bucketed star."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from test_production import AT, DAY, batch, batches, stop, stops

from tillfloor import schemas
from tillfloor.plans import stored
from tillfloor.sources import dated, read_fact, write_fact
from tillfloor.sources.rejects import load_with_rejects

OTHER = dt.date(2021, 1, 5)
FACT = "fact_production_batch"


def _ids(df):
    return sorted(r.batch_id for r in df.collect())


def test_bad_lines_are_set_apart_with_a_reason(spark, tmp_path):
    header = ",".join(schemas.FACT_DOWNTIME.names)
    good = f'D1,B1,1,{DAY},{AT},{AT},1.5,1,01,"x, y",01,x,true'
    bad = {
        f"D2,B1,one,{DAY},{AT},{AT},1,1,01,x,01,x,true": "machine_id is not a int",
        f"D3,B1,1,{DAY},{AT},{AT},1,1,01,x,01,x,perhaps": "was_logged is not a boolean",
        f"D4,B1,1,{DAY}": "wrong number of fields",
        f"D5,B1,1,{DAY},{AT},{AT},1,1,01,x,01,x,true,more": "wrong number of fields",
    }
    (tmp_path / "in.csv").write_text("\n".join([header, good, *bad]) + "\n")
    target, refused = str(tmp_path / "fact"), str(tmp_path / "rejects")
    loaded = load_with_rejects(spark, "fact_downtime", str(tmp_path / "in.csv"), target, refused)
    assert loaded == (1, 4)
    row = spark.read.parquet(target).first()
    assert row.downtime_id == "D1" and row.reported_reason_label == "x, y" and row.duration_minutes == 1.5
    assert {r.rejected_line: r.reason for r in spark.read.parquet(refused).collect()} == bad


def test_a_file_without_lines_loads_nothing(spark, tmp_path):
    (tmp_path / "in.csv").write_text(",".join(schemas.FACT_DOWNTIME.names) + "\n")
    loaded = load_with_rejects(
        spark, "fact_downtime", str(tmp_path / "in.csv"), str(tmp_path / "f"), str(tmp_path / "r")
    )
    assert loaded == (0, 0) and spark.read.parquet(str(tmp_path / "r")).count() == 0


def test_reload_replaces_its_dates_alone(spark, tmp_path):
    path = str(tmp_path / "fact")
    assert dated.read_dated(spark, FACT, path).count() == 0
    both = [batch("B1", 60.0, 48.0, 9, 1), batch("B2", 60.0, 48.0, 9, 1, day=OTHER)]
    dated.reload_dates(batches(spark, both), FACT, path)
    kept = {f for f in dated.read_dated(spark, FACT, path).inputFiles() if str(OTHER) in f}
    dated.reload_dates(batches(spark, [batch("B3", 60.0, 48.0, 9, 1)]), FACT, path)
    now = dated.read_dated(spark, FACT, path)
    assert _ids(now) == ["B2", "B3"] and kept <= set(now.inputFiles()) and kept
    assert now.columns == schemas.FACT_BATCH.names
    assert now.where(F.col("production_date") == OTHER).first().batch_id == "B2"
    dated.reload_dates(batches(spark, []), FACT, path, emptied=[OTHER])
    assert _ids(dated.read_dated(spark, FACT, path)) == ["B3"]


def test_a_failed_reload_leaves_every_date_readable(spark, tmp_path):
    path = str(tmp_path / "fact")
    dated.reload_dates(batches(spark, [batch("B1", 60.0, 48.0, 9, 1)]), FACT, path)
    new = batches(spark, [batch("B2", 60.0, 48.0, 9, 1)])
    broken = new.withColumn("batch_id", F.raise_error(F.lit("disk is gone")).cast("string"))
    with pytest.raises(Exception, match="disk is gone"):
        dated.reload_dates(broken, FACT, path)
    with pytest.raises(Exception, match="no production date"):
        dated.reload_dates(new.withColumn("production_date", F.lit(None).cast("date")), FACT, path)
    assert _ids(dated.read_dated(spark, FACT, path)) == ["B1"]


def test_old_files_read_in_the_declared_columns(spark, tmp_path):
    path, table = str(tmp_path / "fact"), "fact_quality_inspection"
    rows = [("I1", "B1", DAY, AT, 5, 1, "PASS", "crust")]
    new = spark.createDataFrame(rows, schemas.FACT_INSPECTION)
    old = new.drop("defects_found", "defect_type").withColumn("inspection_id", F.lit("I0"))
    old.write.partitionBy("production_date").parquet(path)
    assert read_fact(spark, table, path).first().defects_found is None
    write_fact(new, table, path, mode="append")
    # A frame that lacks columns is written with all of them.
    write_fact(old.withColumn("inspection_id", F.lit("I2")), table, path, mode="append")
    got = {r.inspection_id: (r.defects_found, r.defect_type) for r in read_fact(spark, table, path).collect()}
    assert got == {"I0": (None, None), "I1": (1, "crust"), "I2": (None, None)}
    assert read_fact(spark, table, path).columns == schemas.FACT_INSPECTION.names


def test_undeclared_or_retyped_columns_are_refused(spark, tmp_path):
    path = str(tmp_path / "fact")
    b = batches(spark, [batch("B1", 60.0, 48.0, 9, 1)])
    b.withColumn("machine_id", F.col("machine_id").cast("string")).withColumn("oven", F.lit(1)).write.parquet(path)
    with pytest.raises(ValueError, match="machine_id string, oven int"):
        read_fact(spark, FACT, path)


def test_facts_meet_by_batch_without_a_shuffle(spark):
    products = spark.createDataFrame([(1, "PAIN")], "product_id int, product_name string")
    tables = {
        "dim_product": products,
        FACT: batches(spark, [batch("B1", 60.0, 48.0, 9, 1), batch("B2", 60.0, 60.0, 9, 1)]),
        "fact_downtime": stops(spark, [
            stop("D1", "B1", 10.0, 10.0, "01", "01"), stop("D2", "B1", 2.0, 2.0, "06", "06", False),
        ]),
        "fact_quality_inspection": spark.createDataFrame(
            [("I1", "B2", DAY, AT, 5, 0, "FAIL", None)], schemas.FACT_INSPECTION
        ),
    }
    history = stored.batch_history(stored.staged_star(tables))
    plan = history._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
    got = {r.batch_id: (r.product_name, r.stops, r.logged_stops, r.stop_minutes, r.failed) for r in history.collect()}
    assert got == {"B1": ("PAIN", 2, 1, 12.0, 0), "B2": ("PAIN", 0, 0, 0.0, 1)}
