"""Near duplicates: banded MinHash candidates, sequential Bayesian verification, exact confirmation.

A document's set is its distinct k-word shingles. Equal sets are one node, represented by the smallest id.
Signatures of `BANDS * ROWS` minima are cut into bands; documents that share a band meet in a
bucket. At 0.8 similarity a pair misses every bucket with probability (1 - 0.8^4)^32, or 5e-8.

No join makes pairs. The members of a bucket that are in different components meet as one sorted run of rows,
with a byte of each minimum, and are compared inside the task; what goes on is one row for each member of a
bucket with a partner. These rows meet once more with their full sets, where each pair is
confirmed unless earlier links of the run have joined it. A pair that shares several bands is tested in
the first one only, and never if the sizes of its sets rule it out.

A bucket of more than `BLOCK` members is cut into blocks, differently in each band, and first the members of one block meet.
That joins a group of copies, which share most bands, with linear work. Where such a bucket then still holds several
components, it is cut into blocks by component and every two blocks meet, but for two of one component: no pair that
shares a band is left out, however many members a bucket has. The work on a crowd that is similar but not linked
grows with its square, inside the tasks; the rows that are shuffled grow with its square over `BLOCK`.

A pair is verified in steps: batches of the signature are compared, and after each one the pair is dropped when
the posterior probability that its similarity reaches the threshold (uniform prior) is
below `MISS`. Survivors are confirmed on their full shingle sets.

Documents without words, or with a null text, have empty sets and link with nothing. Rows with a null
id are left out: they cannot be named. Rows repeated under one id are one document; if
their texts differ, the one with the smallest hash counts. Columns other than id and text
are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillfloor.llm.common import by_document, likely, shingle_hashes, stage, text_rows, word_hashes
from tillfloor.llm.components import components
from tillfloor.session import Scratch

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 32
#: Chance that a pair at the threshold is dropped by one batch bound.
MISS = 1e-6
#: Members of a bucket that meet in one run of rows; larger buckets are cut.
BLOCK = 512
#: Pairs that a task compares at once.
PAIRS = 1 << 17


def lower_ascii(text: bytes) -> bytes:
    return text.lower()  # of bytes: A-Z only


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles."""
    return np.unique(shingle_hashes(word_hashes(lower_ascii(text)), k))


def digest_of(own: np.ndarray) -> str:
    return hashlib.blake2b(own.tobytes(), digest_size=16).hexdigest()


def _sets(k: int):
    """(doc_id, mark, set digest, set) of each (doc_id, text, mark)."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                own = [shingle_set(t or b"", k) for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([digest_of(x) for x in own]),
                     pa.array([x.tobytes() for x in own], pa.binary())],
                    names=["doc_id", "mark", "digest", "own"],
                )

    return run


def _factors() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240501)
    odd = draw.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return odd[:, None], draw.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]


def signature_function(k: int):
    """The function of one text: set size, set digest, one byte of each minimum, band keys."""

    def of():
        odd, shift = _factors()
        band = np.arange(BANDS, dtype=np.uint64)

        def each(text: bytes) -> tuple:
            own = shingle_set(text, k)
            if not len(own):
                return 0, None, None, None
            low = (own >> np.uint64(32)).astype(np.uint32)
            least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
            for at in range(0, len(low), 2048):
                np.minimum(least, (low[at : at + 2048][None, :] * odd + shift).min(axis=1), out=least)
            rows = least.reshape(BANDS, ROWS).astype(np.uint64)
            key = band + np.uint64(1)
            for i in range(ROWS):
                key = (key ^ rows[:, i]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            short = (least * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
            return len(own), digest_of(own), short.tobytes(), key.astype(np.int64).tolist()

        return each

    return of


def set_function(k: int):
    """The function of one text: its set digest, null for an empty set."""

    def each(text: bytes) -> tuple:
        own = shingle_set(text, k)
        return (digest_of(own) if len(own) else None,)

    return lambda: each


def least_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(hashes compared, fewest matches to go on) after each batch."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        need = 0
        # posterior Beta(m + 1, n - m + 1): P(s >= t) is the chance of at most m successes in n + 1 draws at t
        terms = [math.comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(n + 2)]
        while need <= n and math.fsum(terms[: need + 1]) < miss:
            need += 1
        out.append((n, need))
    return out


def _alive(a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The rows of two signature arrays that no batch bound drops, and their matches.

    Different minima share their byte once in 256 times, which only lets more pairs through.
    """
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for n, need in bounds:
        part = slice(n - BATCH, n)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= need]
    return alive, matches[alive]


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def _reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _set_of(column: pa.Array, i: int) -> np.ndarray:
    return np.frombuffer(column[i].as_buffer(), np.uint64)


def _runs(batches):
    """Batches cut so that no run of equal keys (the first column, sorted) is in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        first = int(np.searchsorted(keys, keys[-1]))  # where the last run begins
        if held and held[-1].column(0)[0].as_py() != keys[0]:
            yield _joined(held)
            held = []
        if first:
            yield _joined([*held, batch.slice(0, first)])
            held = []
        held.append(batch.slice(first))
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


#: Rows that meet: key of the run, side (-1: all meet, else 0 meets 1), band, node, its component, set size, signature.
MEET = "key long, side int, band int, node long, at long, n long, signature binary"


def _survivors(batch: pa.RecordBatch, bounds: list[tuple[int, int]], percent: int):
    """(i, j, matches): rows of one run, in different components, that may be linked and first share this run's band."""
    key, side, band, at, n = (batch.column(c).to_numpy() for c in (0, 1, 2, 4, 5))
    signature = _signatures(batch.column(6))
    words = signature.view(np.uint32)  # ROWS minima are one word: a band
    partners = np.searchsorted(key, key, "right") - np.arange(len(key)) - 1
    ends = np.cumsum(partners)
    low = 0
    while low < len(key):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        count = partners[low:high]
        i = np.repeat(np.arange(low, high), count)
        j = i + 1 + np.arange(len(i)) - np.repeat(ends[low:high] - count - done, count)
        low = high
        fit = (at[i] != at[j]) & ((side[i] < 0) | (side[i] != side[j]))
        fit &= 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
        i, j = i[fit], j[fit]
        first = (words[i] == words[j]).argmax(axis=1) >= band[i]
        i, j = i[first], j[first]
        alive, matches = _alive(signature[i], signature[j], bounds)
        if len(alive):
            yield i[alive], j[alive], matches


def _with_partners(threshold: float, miss: float):
    """The rows that have a surviving partner in their run."""
    bounds, percent = least_matches(threshold, miss), round(100 * threshold)

    def run(batches):
        for batch in _runs(batches):
            keep = np.zeros(batch.num_rows, bool)
            for i, j, _ in _survivors(batch, bounds, percent):
                keep[i] = keep[j] = True
            if keep.any():
                yield batch.filter(pa.array(keep))

    return run


def _linked(threshold: float, miss: float):
    """The components (a, b) of the confirmed pairs of each run, but for those that earlier ones have joined; likely ones first."""
    bounds, percent = least_matches(threshold, miss), round(100 * threshold)

    def run(batches):
        for batch in _runs(batches):
            at, own = batch.column(4).to_pylist(), batch.column(7)
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while (up := root.get(x, x)) != x:  # noqa: B023
                    root[x] = root.get(up, up)  # noqa: B023
                    x = up
                return x

            out: list[tuple[int, int]] = []
            for i, j, matches in _survivors(batch, bounds, percent):
                for k in np.argsort(-matches, kind="stable"):
                    x, y = find(at[i[k]]), find(at[j[k]])
                    if x != y and _reaches(_set_of(own, int(i[k])), _set_of(own, int(j[k])), percent):
                        root[max(x, y)] = min(x, y)
                        out.append((at[i[k]], at[j[k]]))
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def one_row_each(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return text_rows(docs, id_col, text_col).filter(F.col("doc_id").isNotNull())


def _links(meeting: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, threshold: float, miss: float, keep) -> DataFrame:
    """(a, b): links between the components of the rows (key, side, band, node, at) that meet in a run."""
    columns = [x.split()[0] for x in MEET.split(", ")]
    alive = keep(
        meeting.join(nodes.select("node", "n", "signature"), "node").select(*columns)
        .repartition("key").sortWithinPartitions("key").mapInArrow(_with_partners(threshold, miss), MEET)
    )
    # written first, so that Spark sees how few they are
    marks = keep(nodes.select("node", F.xxhash64("digest").alias("mark")).join(alive.select("node").distinct(), "node"))
    # texts are cut to the nodes in question before they are shuffled; a text that an id has several times counts once
    few = likely(texts, "doc_id", marks.select("node"))
    rows = (
        few.join(marks.withColumnRenamed("node", "doc_id"), "doc_id")
        .withColumn("hash", text_hash(F.col("text"))).dropDuplicates(["doc_id", "hash"]).select("doc_id", "text", "mark")
    )
    sets = rows.mapInArrow(_sets(k), "doc_id long, mark long, digest string, own binary")
    # an id may have other texts
    sets = keep(sets.filter(F.xxhash64("digest") == F.col("mark")).select(F.col("doc_id").alias("node"), "own"))
    met = alive.join(sets, "node").select(*columns, "own").repartition("key").sortWithinPartitions("key")
    return keep(met.mapInArrow(_linked(threshold, miss), "a long, b long"))


def _by_component(large: DataFrame) -> DataFrame:
    """What meets of the large buckets' (bucket, band, node, at): every two blocks with different components."""
    both = large.groupBy("bucket").agg(F.min("at").alias("low"), F.max("at").alias("high")).filter("low < high")
    open_ = large.join(both.select("bucket"), "bucket")
    # a component of more than a block has blocks of its own, which do not meet each other
    of_at = open_.groupBy("bucket", "at").agg(F.count("*").alias("c"))
    of_bucket = of_at.groupBy("bucket").agg(F.sum(F.when(F.col("c") <= BLOCK, F.col("c"))).alias("rest"))
    named = of_at.join(of_bucket, "bucket").select(
        "bucket", "at", F.when(F.col("c") > BLOCK, F.col("at")).alias("own"),
        F.ceil(F.when(F.col("c") > BLOCK, F.col("c")).otherwise(F.col("rest")) / BLOCK).alias("slots"),
    )
    placed = open_.join(named, ["bucket", "at"]).select(
        "bucket", "band", "node", "at", "own",
        F.pmod(F.xxhash64(F.when(F.col("own").isNull(), F.col("at")).otherwise(F.col("node"))), "slots").alias("slot"),
    )
    labelled = placed.withColumn("label", F.struct(F.coalesce("own", F.lit(-1)).alias("own"), "slot")).drop("slot")
    labels = labelled.select("bucket", "label", "own").distinct()
    x, y = labels.toDF("bucket", "lx", "ox"), labels.toDF("bucket", "ly", "oy")
    together = x.join(y, "bucket").filter(
        (F.col("lx") <= F.col("ly")) & ~F.coalesce(F.col("ox") == F.col("oy"), F.lit(False))
    )
    same = F.col("lx") == F.col("ly")
    keyed = together.select("bucket", F.xxhash64("bucket", "lx", "ly").alias("key"), "lx", "ly", same.alias("same"))
    sides = keyed.select("bucket", "key", F.col("lx").alias("label"), F.when(F.col("same"), -1).otherwise(0).alias("side")).union(
        keyed.filter(~F.col("same")).select("bucket", "key", "ly", F.lit(1))
    )
    return labelled.join(sides, ["bucket", "label"]).select("key", "side", "band", "node", "at")


def text_hash(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def counting_texts(rows: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, text_hash) of the text that counts for each id of (doc_id, text): that of the smallest set."""
    hashed = rows.select("doc_id", "text", text_hash(F.col("text")).alias("hash"))
    texts = hashed.groupBy(F.col("hash").alias("doc_id")).agg(F.first("text").alias("text"))
    signed = by_document(texts.withColumn("text", F.coalesce("text", F.lit(""))), set_function(k), "digest string")
    own = hashed.select("doc_id", "hash").join(signed.toDF("hash", "digest"), "hash")
    return own.groupBy("doc_id").agg(F.min(F.struct("digest", "hash")).alias("x")).select("doc_id", F.col("x.hash").alias("text_hash"))


def near_duplicates(
    docs: DataFrame, k: int = 5, threshold: float = 0.8, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    with Scratch(docs.sparkSession) as scratch:
        return stage(_near_duplicates(docs, k, threshold, miss, id_col, text_col, scratch.stage))


def _near_duplicates(docs: DataFrame, k: int, threshold: float, miss: float, id_col: str, text_col: str, keep) -> DataFrame:
    rows = one_row_each(docs, id_col, text_col)
    signed = keep(by_document(
        rows.withColumn("text", F.coalesce("text", F.lit(""))), signature_function(k),
        "n_shingles long, digest string, signature binary, bands array<long>",
    ))
    # one set for each id: the smallest digest, an empty set first
    ids = keep(signed.groupBy("doc_id").agg(F.min(F.struct("digest", "n_shingles")).alias("x")).select("doc_id", "x.*"))
    reps = ids.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("node"))
    own = signed.join(reps.select(F.col("node").alias("doc_id"), "digest", "node"), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
    nodes = keep(own.select("node", "digest", F.col("n_shingles").alias("n"), "signature", "bands"))
    bands = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    buckets = keep(bands.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1"))
    slot = F.pmod(F.xxhash64("node", "band"), F.ceil(F.col("m") / BLOCK))
    first = bands.join(buckets, "bucket").select(
        F.xxhash64("bucket", slot).alias("key"), F.lit(-1).alias("side"), "band", "node", F.col("node").alias("at")
    )
    of_node = keep(components(_links(first, nodes, rows, k, threshold, miss, keep), keep))
    at = nodes.select("node", "digest").join(of_node, "node", "left").select("node", "digest", F.coalesce("component", "node").alias("at"))
    large = buckets.filter(F.col("m") > BLOCK).select("bucket")
    if not large.isEmpty():
        crowded = bands.join(large, "bucket").join(of_node, "node", "left")
        crowded = keep(crowded.select("bucket", "band", "node", F.coalesce("component", "node").alias("at")))
        further = components(_links(_by_component(crowded), nodes, rows, k, threshold, miss, keep), keep)
        further = further.withColumnRenamed("node", "at")
        at = at.join(further, "at", "left").withColumn("at", F.coalesce("component", "at"))
    out = ids.join(at.select("digest", "at"), "digest", "left")
    return out.select(
        "doc_id", "n_shingles", F.coalesce("at", "doc_id").alias("component_id")
    ).withColumn("kept", F.col("doc_id") == F.col("component_id"))


# DuckDB: every pair of different sets with a shingle in common, then components by closure
ORACLE = r"""
with recursive d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_sort(list_distinct([array_to_string(w[i : i + 3], ' ') for i in range(1, len(w) - 2)])) end as own from d
), reps as (
  select min(doc_id) as node, any_value(own) as own, len(any_value(own)) as n from s where len(own) > 0 group by hash(own), own
), x as (
  select node, n, unnest(own) as g from reps
), pairs as (
  select a.node as a, b.node as b from x a join x b on a.g = b.g and a.node < b.node
  where 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.node, b.node, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges as (
  select a, b from pairs union all select b, a from pairs union all select node, node from reps
), walk as (
  select a, b from edges union select w.a, e.b from walk w join edges e on w.b = e.a
), comp as (
  select a as node, min(b) as c from walk group by a
)
select s.doc_id, len(s.own) as n_shingles, coalesce(c, s.doc_id) as component_id, coalesce(c, s.doc_id) = s.doc_id as kept
from s left join reps on s.own = reps.own left join comp using (node)
"""
