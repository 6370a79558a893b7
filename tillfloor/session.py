"""Session settings and staging of intermediate results."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench. A cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tillfloor")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


_local_folders: dict[str, str] = {}


def staging_folder(spark: SparkSession) -> str:
    """A folder of this application inside the shared one that spark.checkpoint.dir names.

    Only a single-process local session may go without the setting: it gets a temporary
    folder that ends with the process. The caller's session is left as it is.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if shared is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        if context.applicationId not in _local_folders:
            made = tempfile.mkdtemp(prefix="tillfloor-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            _local_folders[context.applicationId] = made
        shared = _local_folders[context.applicationId]
    return f"{shared.rstrip('/')}/tillfloor-{context.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_staging(spark: SparkSession) -> None:
    """Delete what this application has staged. Results read from it must be written by then."""
    _delete(spark, staging_folder(spark))


def stage(df: DataFrame) -> DataFrame:
    """Write a result once to the shared folder and read it from there.

    For a result that several branches of one query need: the branches share one
    pass over the source, each reads only the columns it uses, joins know its
    size, and a lost executor costs a file read. `clear_staging` removes the files.
    """
    return _staged(df, f"{staging_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}")


def _staged(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Staged results with a life span: all of them are deleted when the block ends.

    What leaves the block must be staged outside it, or not read from it.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{staging_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.made = 0
        self.named: set[str] = set()

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        _delete(self.spark, self.folder)

    def stage(self, df: DataFrame) -> DataFrame:
        self.made += 1
        return _staged(df, f"{self.folder}/{self.made}")

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows to the result of this name, for what is made part by part."""
        df.write.mode("append").parquet(f"{self.folder}/{name}")
        self.named.add(name)

    def appended(self, name: str, schema: str) -> DataFrame:
        if name not in self.named:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")


#: Spark's setting by which a query's shuffle files go when it ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each query that runs in the block go at that query's end. The setting is put back after it.

    For steps that stage what they make: nothing reads the shuffles of a step again.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
