"""Loads that set bad lines apart: accepted rows, and rejects with the reason for each."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillfloor import schemas
from tillfloor.session import Scratch
from tillfloor.sources.sinks import write_fact

#: The column that holds the whole text of a line that does not fit its schema.
LINE = "rejected_line"
QUOTES = {"quote": '"', "escape": '"'}


def scan_with_rejects(
    spark: SparkSession, path: str, schema: T.StructType, header: bool = True
) -> DataFrame:
    """The declared columns, and the text of each line that does not fit them.

    Which lines fit depends on the columns that are read, so the scan is to be
    written whole (`Scratch.stage`) before it is split.
    """
    kept = T.StructType([*schema.fields, T.StructField(LINE, T.StringType())])
    return (
        spark.read.schema(kept)
        .options(**QUOTES, header=header, enforceSchema=False, mode="PERMISSIVE")
        .option("columnNameOfCorruptRecord", LINE)
        .csv(path)
    )


def reject_reason(line: Column, schema: T.StructType) -> Column:
    """Why a line was refused: its number of fields, or the first column whose text has not its type."""
    texts = ", ".join(f"`{name}` STRING" for name in [*schema.names, LINE])
    options = {**QUOTES, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": LINE}
    fields = F.from_csv(line, texts, options)
    unlike = [
        F.when(
            fields[f.name].isNotNull() & fields[f.name].try_cast(f.dataType).isNull(),
            F.lit(f"{f.name} is not a {f.dataType.simpleString()}"),
        )
        for f in schema
    ]
    count = F.when(fields[LINE].isNotNull(), F.lit("wrong number of fields"))
    return F.coalesce(count, *unlike, F.lit("unreadable"))


def split_rejects(scanned: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Accepted rows of the declared columns, and rejects as (rejected_line, reason)."""
    accepted = scanned.where(F.col(LINE).isNull()).select(*[f"`{n}`" for n in schema.names])
    refused = scanned.where(F.col(LINE).isNotNull())
    return accepted, refused.select(LINE, reject_reason(F.col(LINE), schema).alias("reason"))


class Loaded(NamedTuple):
    accepted: int
    rejected: int


def load_with_rejects(
    spark: SparkSession, table: str, csv_path: str, target: str, rejects: str
) -> Loaded:
    """Replace a fact by the good lines of a CSV file; write the others to a folder of rejects.

    The file is parsed once, and both sides are counted while that is written.
    """
    schema = schemas.STAR_TABLES[table]
    seen = Observation()
    counted = scan_with_rejects(spark, csv_path, schema).observe(
        seen,
        F.count_if(F.col(LINE).isNull()).alias("accepted"),
        F.count_if(F.col(LINE).isNotNull()).alias("rejected"),
    )
    with Scratch(spark) as scratch:
        accepted, refused = split_rejects(scratch.stage(counted), schema)
        refused.write.mode("overwrite").parquet(rejects)
        write_fact(accepted, table, target)
    return Loaded(**seen.get)


def reject_counts(accepted: DataFrame, rejects: DataFrame) -> DataFrame:
    """Lines of both sides by reason; accepted lines have none."""
    good = accepted.agg(F.count("*").alias("lines")).select(
        F.lit("accepted").alias("side"), F.lit(None).cast("string").alias("reason"), "lines"
    )
    bad = rejects.groupBy("reason").agg(F.count("*").alias("lines"))
    return good.unionByName(bad.select(F.lit("rejected").alias("side"), "reason", "lines"))
