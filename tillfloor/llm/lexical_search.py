"""Ranked lexical search by bag deduplication.

A document's bag is its term counts restricted to the vocabulary of the items, and m, its length against
the mean one (in hundredths, a quarter of it fixed). Documents of one bag and m have one score for every item, so they
form a class: bags are hashed, those of one hash are compared in full, and each class is scored once. The
members of the few classes that reach an item's best `k` are then listed by ascending id.

Items are taken in blocks of at most `block_words` words (a longer item is a block of its own), which
bounds the vocabulary and weights that go to every task; each block is held against all documents. A task keeps the
best `k` classes of each item. These hold the best `k` documents: a class that k others precede by
(score, smallest id) has k documents before its first.

Every row is a document, repeated ids and equal rows included; null or empty texts have no terms and count in no
statistic. A null id sorts after all others and is returned as null. Items with a null id or no term find nothing; items
repeated with one id and text count once, several texts of one id are one item (its terms together). Terms that no
document holds add nothing. Columns other than id and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillfloor.llm.common import stage, text_rows

BLOCK_WORDS = 100_000
#: Contributions to scores that a task holds at once.
CHUNK = 1 << 20
OTHER = bytes(c for c in range(128) if not chr(c).isalnum())
TO_SPACE = bytes.maketrans(OTHER, b" " * len(OTHER))
#: What two documents of one class share.
CLASS = ["hash", "m", "bag"]


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, A-Z lower-cased: runs of ASCII letters, digits and bytes beyond ASCII."""
    return text.lower().translate(TO_SPACE).split(b" ")


def item_texts(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row an item: item_id as it came, and its different texts."""
    return (
        items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
        .filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
        .groupBy("item_id")
        .agg(F.collect_set("text").alias("texts"))
    )


def blocks(items: DataFrame, block_words: int):
    """Lists of (item_id, {term: times}) of at most `block_words` words, read a file at a time."""
    block, size = [], 0
    for row in items.toLocalIterator():
        own = Counter(t for text in row["texts"] for t in terms_of(text.encode()) if t)
        if block and size + own.total() > block_words:
            yield block
            block, size = [], 0
        if own:
            block.append((row["item_id"], own))
            size += own.total()
    if block:
        yield block


def bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, bag) of every document with a term: bag is the ids, then the counts, of its vocabulary terms."""

    def bag(text: bytes) -> tuple[int, bytes]:
        found = [t for t in terms_of(text) if t]
        known = [i for i in map(vocabulary.get, found) if i is not None]
        ids, times = np.unique(np.array(known, np.int32), return_counts=True)
        return len(found), ids.tobytes() + times.astype(np.int32).tobytes()

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                n, own = zip(*(bag(t or b"") for t in part.column(1).cast(pa.binary()).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(own, pa.binary())], names=["doc_id", "n", "bag"]
                )

    return docs.mapInArrow(run, "doc_id long, n long, bag binary").filter("n > 0")


def document_counts(found: DataFrame, size: int) -> DataFrame:
    """(term, df): documents that hold each vocabulary term, summed in each task before the shuffle."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for own in batch.column(0).to_pylist():
                ids = np.frombuffer(own, np.int32)
                total[ids[: len(ids) // 2]] += 1
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], names=["term", "df"])

    return found.select("bag").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def classes(found: DataFrame, n: int, length: int) -> DataFrame:
    """Every document with a vocabulary term, with m and the hash of its bag."""
    return (
        found.filter(F.octet_length("bag") > 0)
        .withColumn("m", F.expr(f"25 + (75 * n * {n}L) div {length}L"))
        .select("doc_id", "m", "bag", F.xxhash64("bag", "m").alias("hash"))
    )


def scored(distinct: DataFrame, block: list, index: dict[bytes, int], weights: np.ndarray, k: int) -> DataFrame:
    """(item, score, first, hash, m, bag): each task's best k classes of each item of the block, by score and first id."""
    entries = sorted((index[t], i, times * int(weights[index[t]])) for i, (_, own) in enumerate(block) for t, times in own.items())
    term, item, value = (np.array(c, np.int64) for c in (zip(*entries, strict=True) if entries else ((), (), ())))
    from_ = np.searchsorted(term, np.arange(len(index) + 1))
    n_items = len(block)

    def run(batches):
        lists: list[list[tuple]] = [[] for _ in range(n_items)]  # of (score, first id, hash, m, bag)

        def add(part) -> None:
            m = part["m"].to_numpy()
            bag = part["bag"].to_pylist()
            first = part["doc_id"].to_pylist()
            hashes = part["hash"].to_pylist()
            own = [np.frombuffer(x, np.int32).astype(np.int64).reshape(2, -1) for x in bag]
            row = np.repeat(np.arange(len(own)), [x.shape[1] for x in own])
            ids, tf = np.concatenate(own, axis=1)
            c = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
            scores = np.zeros(len(own) * n_items, np.int64)
            many = from_[ids + 1] - from_[ids]
            ends = np.cumsum(many)
            at = 0
            while at < len(ids):  # a text of many terms and items goes in several chunks
                done = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + CHUNK, "right")))
                reps = many[at:to]
                entry = np.arange(reps.sum()) - np.repeat(ends[at:to] - reps - done, reps) + np.repeat(from_[ids[at:to]], reps)
                np.add.at(scores, np.repeat(row[at:to], reps) * n_items + item[entry], np.repeat(c[at:to], reps) * value[entry])
                at = to
            scores = scores.reshape(len(own), n_items)
            for i in np.flatnonzero(scores.max(axis=0) > 0):
                column = scores[:, i]
                floor = max(1, lists[i][-1][0] if len(lists[i]) == k else 1)
                if len(column) > k:
                    floor = max(floor, int(np.partition(column, -k)[-k]))
                rows = np.flatnonzero(column >= floor)
                if len(rows):
                    lists[i] += [(int(column[r]), first[r], hashes[r], int(m[r]), bag[r]) for r in rows]
                    lists[i].sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
                    del lists[i][k:]

        step = max(1, min(4096, (1 << 22) // n_items))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                add({c: part.column(c) for c in part.schema.names})
        for i, own in enumerate(lists):
            if own:
                score, first, hashes, m, bag = zip(*own, strict=True)
                whole = [pa.array(c, pa.int64()) for c in ([i] * len(own), score, first, hashes, m)]
                yield pa.RecordBatch.from_arrays(
                    [*whole, pa.array(bag, pa.binary())], names=["item", "score", "first", "hash", "m", "bag"]
                )

    return distinct.mapInArrow(run, "item long, score long, first long, hash long, m long, bag binary")


def best(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key; each task cuts its own rows to k before they are shuffled."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, block_words: int = BLOCK_WORDS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of every item."""
    spark = docs.sparkSession
    rows = text_rows(docs, id_col, text_col)
    wanted = stage(item_texts(items))
    kind = wanted.schema["item_id"].dataType.simpleString()
    out = None
    for block in blocks(wanted, block_words):
        index = {t: i for i, t in enumerate(sorted({t for _, own in block for t in own}))}
        found = stage(bags(rows, index))
        total = found.agg(F.count("*").alias("n"), F.sum("n").alias("length")).first()
        if not total["n"]:
            break
        counts = np.zeros(len(index), np.int64)
        for row in document_counts(found, len(index)).collect():  # one row a term of the block at most
            counts[row["term"]] = row["df"]
        weights = np.array([weight(total["n"], int(df)) for df in counts], np.int64)
        members = classes(found, total["n"], total["length"])
        distinct = members.groupBy(*CLASS).agg(F.min("doc_id").alias("doc_id"))
        tops = scored(distinct, block, index, weights, k)
        winners = stage(best(tops, ["item"], [F.desc("score"), F.asc_nulls_last("first")], k).drop("rank"))
        held = members.join(winners.select(*CLASS).distinct(), CLASS)
        first_ids = best(held, CLASS, [F.asc_nulls_last("doc_id")], k).drop("rank")
        listed = winners.join(first_ids, CLASS).select("item", "score", "doc_id")
        part = best(listed, ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], k)
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], f"item long, item_id {kind}")
        part = part.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")


# DuckDB: every document and item by their common terms, in whole numbers
ORACLE = r"""
with d as (
  select row_number() over () as r, doc_id, unnest(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) as term from documents
), b as (
  select item_id, unnest(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) as term from benchmark
), q as (
  select item_id, term, count(*) as times from b group by all
), tf as (
  select r, doc_id, term, count(*) as tf from d group by all
), lens as (
  select r, sum(tf)::bigint as n from tf group by r
), total as (
  select count(*) as big_n, sum(n)::bigint as big_l from lens
), df as (
  select term, count(*) as df from tf group by term
), w as (
  select term, floor(1000 * ln((2 * big_n + 2)::double / (2 * df + 1)))::bigint as w from df, total
), m as (
  select r, 25 + (75 * n * big_n) // big_l as m from lens, total
), s as (
  select item_id, r, any_value(doc_id) as doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from q join tf using (term) join w using (term) join m using (r) group by item_id, r
), ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last)::int as rank, doc_id, score
  from s where score > 0
)
select * from ranked where rank <= 10
"""
