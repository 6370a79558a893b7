from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_production import AT, DAY, batch, batches, stop, stops

from tillfloor import params as P
from tillfloor import schemas
from tillfloor.operators import checks
from tillfloor.plans.build import build
from tillfloor.plans.star import listed_star_tables, register_views
from tillfloor.sources import (
    add_missing_columns,
    append_by_position,
    current_version,
    load_fact,
    publish_if_valid,
    published,
    read_clean_sales,
    read_raw_sales,
    replace_table,
    write_csv,
    write_fact,
)

RAW = """,date,time,ticket_number,article,Quantity,unit_price
0,2021-01-02,08:38,150040.0,BAGUETTE,1.0,"0,90 €"
1,2021-01-02,09:14,150041.0,"PLATPREPARE6,50",2.0,"6,50 €"
4,2021-01-02,09:15,150042.0,BAGUETTE,-1.0,"0,90 €"
"""


def test_raw_export_with_a_comma_in_a_name(spark, tmp_path):
    path = tmp_path / "till.csv"
    path.write_text(RAW.replace(",date", "Unnamed: 0,date", 1))
    rows = read_raw_sales(spark, str(path)).collect()
    assert rows[1].article == "PLATPREPARE6,50" and rows[1].unit_price == "6,50 €"


def test_clean_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("2021-01-02", "08:38", dt.datetime(2021, 1, 2, 8, 38), 1, 'A "B", C', 1.0, 0.9, 0.9)],
        schemas.CLEAN_SALES,
    )
    write_csv(df, str(tmp_path / "clean"))
    assert read_clean_sales(spark, str(tmp_path / "clean")).collect() == df.collect()


def test_fact_is_partitioned_and_replaced(spark, tmp_path):
    path = str(tmp_path / "fact")
    other = dt.date(2021, 1, 5)
    write_fact(batches(spark, [batch("B1", 60.0, 48.0, 9, 1), batch("B2", 60.0, 48.0, 9, 1,
                                                                      day=other)]),
               "fact_production_batch", path)
    assert (tmp_path / "fact" / f"production_date={DAY}").is_dir()
    pruned = spark.read.parquet(path).where(f"production_date = date'{DAY}'")
    assert [r.batch_id for r in pruned.collect()] == ["B1"]
    # A reload drops partitions that the new data does not have.
    write_fact(batches(spark, [batch("B3", 60.0, 48.0, 9, 1)]), "fact_production_batch", path)
    assert [r.batch_id for r in spark.read.parquet(path).collect()] == ["B3"]


def test_append_maps_columns_by_position(spark, tmp_path):
    path = str(tmp_path / "fact")
    named = batches(spark, [batch("B1", 60.0, 48.0, 9, 1)])
    append_by_position(named.toDF(*[f"c{i}" for i in range(14)]), "fact_production_batch", path)
    append_by_position(named, "fact_production_batch", path)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError, match="14 columns"):
        append_by_position(named.drop("batch_id"), "fact_production_batch", path)


def test_load_reports_rows_and_rejects_bad_types(spark, tmp_path):
    s = stops(spark, [stop("D1", "B1", 10.5, 10.0, "01", "99"), stop("D2", "B1", 2.0, 2.0, "06",
                                                                     "06", False)])
    write_csv(s, str(tmp_path / "csv"))
    target = str(tmp_path / "fact")
    assert load_fact(spark, "fact_downtime", str(tmp_path / "csv"), target) == 2
    assert load_fact(spark, "fact_downtime", str(tmp_path / "csv"), target) == 2
    back = spark.read.parquet(target).select(*schemas.FACT_DOWNTIME.names)
    assert sorted(back.collect()) == sorted(s.collect())
    # Codes keep their leading zero: the schema is declared, not inferred.
    assert {r.true_reason_code for r in back.collect()} == {"01", "06"}
    bad = tmp_path / "bad.csv"
    header = ",".join(schemas.FACT_DOWNTIME.names)
    bad.write_text(f"{header}\nD1,B1,one,{DAY},{AT},{AT},1,1,01,x,01,x,true\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        load_fact(spark, "fact_downtime", str(bad), target)


def test_missing_columns_are_added_once(spark):
    df = spark.createDataFrame([(1, "PAIN")], "product_id int, product_name string")
    full = add_missing_columns(df, schemas.DIM_PRODUCT)
    assert set(full.columns) == set(schemas.DIM_PRODUCT.names)
    assert add_missing_columns(full, schemas.DIM_PRODUCT).columns == full.columns


def test_a_failed_check_or_write_leaves_the_published_rows(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(LookupError, match="nothing is published"):
        published(spark, path)
    publish_if_valid(batches(spark, [batch("B1", 60.0, 48.0, 9, 1)]), path, checks.batch_checks)
    bad = batches(spark, [batch("B2", 60.0, 99.0, 9, 1)])
    with pytest.raises(checks.CheckFailure, match="run time"):
        publish_if_valid(bad, path, checks.batch_checks)
    broken = bad.withColumn("batch_id", F.raise_error(F.lit("disk is gone")).cast("string"))
    with pytest.raises(Exception, match="disk is gone"):
        publish_if_valid(broken, path)
    assert [r.batch_id for r in published(spark, path).collect()] == ["B1"]
    publish_if_valid(batches(spark, [batch("B3", 60.0, 48.0, 9, 1)]), path, checks.batch_checks)
    assert [r.batch_id for r in published(spark, path).collect()] == ["B3"]


def test_incomplete_catalog_is_reported(spark):
    for name in schemas.STAR_TABLES:
        spark.catalog.dropTempView(name)
    register_views({"dim_machine": spark.range(1)})
    with pytest.raises(LookupError, match="dim_product"):
        listed_star_tables(spark)


def test_whole_build(spark, tmp_path: Path):
    names = [s[0] for s in P.OPERATING_STANDARDS] + list(P.EXCLUDED_PRODUCTS)
    till = tmp_path / "till.csv"
    till.write_text("Unnamed: 0,date,time,ticket_number,article,Quantity,unit_price\n" + "".join(
        f'{i},2021-01-04,08:{i:02d},{i}.0,{n},{100 - i}.0,"1,20 €"\n' for i, n in enumerate(names)
    ) + '90,2021-01-04,09:00,90.0,PAIN,-1.0,"1,20 €"\n91,2021-01-04,09:01,91.0,PAIN,1.0,"0,00 €"\n')
    facts = tmp_path / "facts"
    # Product 1 is the best seller, a bread on machine 1.
    write_csv(batches(spark, [batch("B1", 60.0, 48.0, 90, 10)]),
              str(facts / "fact_production_batch.csv"))
    write_csv(stops(spark, [
        stop("D1", "B1", 6.0, 5.0, "98", "99"), stop("D2", "B1", 5.0, 5.0, "01", "99"),
        stop("D3", "B1", 1.0, 1.0, "06", "06", False),
    ]), str(facts / "fact_downtime.csv"))
    write_csv(spark.createDataFrame([("I1", "B1", DAY, AT, 5, 0, "PASS", None)],
                                    schemas.FACT_INSPECTION),
              str(facts / "fact_quality_inspection.csv"))
    result = build(spark, str(till), str(facts), str(tmp_path / "out"))
    assert result.rows == {"fact_production_batch": 1, "fact_downtime": 3,
                           "fact_quality_inspection": 1}
    checks.require_passed(result.checks)
    assert result.published
    assert current_version(spark, str(tmp_path / "out")) == Path(result.folder).name
    assert spark.table("kpi_product_performance").count() == 30
    assert spark.table("v_oee_daily").first().availability == 0.8
    assert read_clean_sales(spark, f"{result.folder}/clean_sales_csv").count() == 30
    assert listed_star_tables(spark) == list(schemas.STAR_TABLES)
    feed = spark.read.option("header", True).csv(f"{result.folder}/dashboard_csv")
    assert feed.columns == ["sale_date", "day_of_week", "sale_month", "product", "units",
                            "revenue"]


def test_replace_table_drops_old_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    replace_table(spark.range(5), path)
    replace_table(spark.range(2), path)
    assert spark.read.parquet(path).count() == 2
