"""Table reading, staging, word rules and hashing shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillfloor.session import stage

__all__ = ["ascii_lower", "by_document", "read_table", "spans_text", "stage", "text_rows", "word_array"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between two alphanumeric words: ASCII other than digits and small letters.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. lower() is right, and fast, on pure ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def word_array(text: Column) -> Column:
    """The alphanumeric words of a text; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


#: Bits of a filter: its size and the broadcast are 2 MB, however many keys there are.
FILTER_BITS = 24


def likely(df: DataFrame, column: str, keys: DataFrame, bits: int = FILTER_BITS, placed: bool = False) -> DataFrame:
    """The rows of df whose column may be among the keys: all that are, and some that are not.

    A bitmap of hashed keys of fixed size (2 ** bits) is broadcast, so that a join that follows shuffles few other rows. With
    more keys than bits it lets most rows through, and costs no more. Keys may be given as their places in the bitmap.
    """
    def place(name: str) -> Column:
        return F.pmod(F.xxhash64(F.col(name).cast("long")), F.lit(1 << bits))

    key = keys.columns[0]
    places = keys.select((F.col(key) if placed else place(key)).alias("place_"))
    bitmaps = places.groupBy(F.bitmap_bucket_number("place_").alias("part_")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place_")).alias("bits_")
    )
    at = F.bitmap_bit_position(place(column))
    byte = F.conv(F.hex(F.substring("bits_", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.pmod(F.floor(byte / F.pow(F.lit(2), at % 8)), F.lit(2)) == 1
    return (
        df.withColumn("part_", F.bitmap_bucket_number(place(column)))
        .join(F.broadcast(bitmaps), "part_").filter(held).select(df.columns)
    )


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text alone, so that no other column of the input can clash with a result."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def by_document(
    docs: DataFrame, of: Callable[[], Callable[[bytes], tuple]], schema: str, step: int = 256
) -> DataFrame:
    """One result row for each row of (doc_id, text), from a function of the text's UTF-8 bytes.

    `of` is called once in each task and returns that function. No shuffle; a task
    holds one Arrow batch of texts and the results of `step` of them.
    """
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = of()
        out = None
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                texts = part.column(1).cast(pa.binary()).to_pylist()
                rows = [each(text or b"") for text in texts]
                columns = list(zip(*rows, strict=True))
                if out is None:
                    out = arrow_types(schema)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, t) for c, t in zip(columns, out, strict=True))],
                    names=["doc_id", *names],
                )

    return docs.mapInArrow(run, f"doc_id long, {schema}")


def arrow_types(schema: str) -> list[pa.DataType]:
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(),
        "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
        "array<int>": pa.list_(pa.int32()),
    }
    return [kinds[x.strip().split(" ")[1]] for x in schema.split(",")]


def spans_text(spans: list[tuple[int, int, str, int]]) -> str:
    """kind:start:end of (start, rank of the kind, kind, end), by start and then kind."""
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans))


# --- hashing of words, in numpy

BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Powers of BASE and of its inverse, made in the worker that first needs them.
_made: dict[str, np.ndarray] = {}


def _power(name: str, n: int) -> np.ndarray:
    if n > len(_made.get(name, ())):
        made = _powers(max(n, 1 << 16), BASE if name == "up" else _INVERSE)
        if n > 1 << 20:
            return made[:n]  # for one very long text; not kept
        _made[name] = made
    return _made[name][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words between ASCII white space, in their order."""
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    if not n:
        return np.empty(0, np.uint64)
    word = np.zeros(n + 2, np.int8)
    word[1:-1] = ~SPACE[data]
    edge = np.diff(word)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", n)[starts])


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words; of all words where there are fewer, but not none."""
    if not len(words):
        return words
    k_here = min(k, len(words))
    n = len(words) - k_here + 1
    out = np.zeros(n, np.uint64)
    for i in range(k_here):
        out = (out + words[i : i + n]) * BASE
    return mix(out + np.uint64(k_here))
