"""From raw documents to shards: language ID, near-dedup, decontamination, mixing, sharding.

Each stage takes what its predecessor kept, whole, and all but the last return the columns of
documents as they came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillfloor.llm import decontaminate, language_id, mixing, near_dedup, sharding
from tillfloor.llm.common import read_table, stage

SHARDS = 24


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no learned centroid is near enough to go: no letter, or text unlike any language.

    Each row is judged by its own text, rows of one id or without an id too.
    """
    return language_id.accepted(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, with one row.

    Of an id with several texts, the row of the text that was compared stays; of its rows with this text, the one with
    the smallest hash of all columns but maps. Rows without an id cannot be named and are kept.
    """
    gone = near_dedup.near_duplicates(docs).filter("not kept").select("doc_id")
    kept = docs.join(stage(gone.distinct()), "doc_id", "left_anti").select(docs.columns)
    again = stage(kept.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"))
    if again.isEmpty():
        return kept
    several = kept.join(again, "doc_id", "left_semi").withColumn("hash_", near_dedup.text_hash(F.col("text")))
    one = stage(near_dedup.counting_texts(several.select("doc_id", F.col("text").cast("string").alias("text"))))
    plain = [f"`{name}`" for name, kind in docs.dtypes if "map<" not in kind]
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(*plain))
    best = (
        several.join(one.toDF("doc_id", "hash_"), ["doc_id", "hash_"], "left_semi")
        .withColumn("at_", F.row_number().over(order)).filter("at_ = 1")
    )
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).union(best.select(docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which a twentieth or more of the words are words of benchmark passages go: each by its own text, with or without an id."""
    found = decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), slack=0)
    gone = stage(found.filter("contaminated").select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_")).distinct())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("id_")) & (near_dedup.text_hash(F.col("text")) == F.col("hash_"))
    return docs.join(gone, same, "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as before, from flatter sources: a document may stand twice or not at all."""
    return mixing.mix(docs)[0]


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot."""
    return sharding.shard(docs, ["doc_id"] + [c for c in docs.columns if c != "doc_id"], SHARDS)


STAGES = [
    ("language_id", with_language),
    ("near_dedup", deduplicated),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Language ID and mixing have no SQL: the tests compare run() with plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
