"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed letter trigrams (bytes of the lower-cased text; what is no letter is
a space), weighted by log term frequency and inverse document frequency, and normalised. Each language has up to
`centroids` unit vectors, found by spherical k-means. A text takes the language of the centroid with the
largest cosine, which is its score, and is rejected where that cosine lies below the centroid's floor: the quantile `miss` of
the cosines that its own training texts have, or all those of its language where its own are too few to show that
quantile. So about `miss` of the texts of learned languages are rejected. A language that shares most trigrams with a learned one
can lie above the floor.

Document frequencies count every training row. The centroids are fitted on a bounded sample: about
`sample` training rows for each language, and never more than twice that on the whole. Training rows
have a text and a language, and a CRC-32 of the id that leaves `held` of `folds`
apart; the id plays no other part, and neither id nor language is read when predicting.

A null text, or one without a letter, is `und` with score 0 and rejected, and so is every text where
nothing was learned. Ties go to the language that sorts first. Repeated rows each get their row. Columns other than id,
text and language are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillfloor.llm.common import stage, text_rows

DIMS = 4096
#: A-Z to a-z, other ASCII to a space, everything else to itself.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def counts_of(text: bytes) -> np.ndarray:
    """How often each hashed trigram stands in the text."""
    data = np.frombuffer(b" " + b" ".join(text.translate(_LETTERS).split()) + b" ", np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(DIMS, np.int64)
    grams = data[:-2] | (data[1:-1] << np.uint32(8)) | (data[2:] << np.uint32(16))
    return np.bincount((grams * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMS)


def has_letter(text: bytes) -> bool:
    low = text.translate(_LETTERS)
    if any(97 <= b <= 122 for b in low[:64]) or low.translate(None, bytes(range(128, 256)) + b" "):
        return True
    return not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace"))


def unit_rows(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts).astype(np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def low_quantile(cosines: np.ndarray, miss: float) -> float:
    """The value that about `miss` of further such cosines lie below; towards 0 where that is less than one of these."""
    at = miss * (len(cosines) + 1)
    return float(np.interp(at, np.arange(len(cosines) + 1), np.concatenate([[0.0], np.sort(np.maximum(cosines, 0.0))])))


def spherical_means(rows: np.ndarray, k: int, miss: float, passes: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Up to k unit centroids, from far-apart seeds, and each one's floor."""
    seeds = [rows.mean(axis=0)]
    near = rows @ (seeds[0] / max(np.linalg.norm(seeds[0]), 1e-12))
    at = [int(near.argmax())]
    near = rows @ rows[at[0]]
    while len(at) < min(k, len(rows)):
        at.append(int(near.argmin()))
        near = np.maximum(near, rows @ rows[at[-1]])
    means = rows[at]
    for _ in range(passes):
        own = (rows @ means.T).argmax(axis=1)
        sums = np.stack([rows[own == i].sum(axis=0) for i in range(len(means))])
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        means = np.where(size > 0, sums / np.maximum(size, 1e-12), means).astype(np.float32)
    cosines = rows @ means.T
    own = cosines.argmax(axis=1)
    used = [i for i in range(len(means)) if (own == i).any()]
    whole = low_quantile(cosines.max(axis=1), miss)
    floors = [low_quantile(cosines[own == i, i], miss) if miss * ((own == i).sum() + 1) >= 1 else whole for i in used]
    return means[used], np.array(floors)


def document_frequencies(train: DataFrame) -> np.ndarray:
    """Training rows that hold each trigram, over all of them, and last how many rows there are."""

    def run(batches):
        total = np.zeros(DIMS + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                total[:DIMS] += counts_of(text) > 0
                total[DIMS] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(total)], names=["dim", "n"])

    out = np.zeros(DIMS + 1)
    for dim, n in train.select("text").mapInArrow(run, "dim long, n long").groupBy("dim").agg(F.sum("n")).collect():
        out[dim] = n
    return out


class Model:
    def __init__(self, idf: np.ndarray, langs: list[str], means: np.ndarray, floors: np.ndarray):
        self.idf, self.langs, self.means, self.floors = idf, langs, means, floors


def fit(train: DataFrame, centroids: int, sample: int, miss: float = 0.005) -> Model | None:
    """The model of (doc_id, text, lang) rows that all have a text and a language."""
    sizes = stage(train.groupBy("lang").count())
    n_langs = sizes.count()
    if not n_langs:
        return None
    seen = document_frequencies(train)
    idf = (np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1).astype(np.float32)
    # an even draw by hash, at the rate that gives each language its number
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    some = (
        train.join(sizes, "lang")
        .filter(draw * F.col("count") < F.lit(float(sample << 30)))
        .select("lang", "text", draw.alias("draw"))
        .orderBy("draw", "lang", "text")
        .limit(2 * sample * n_langs)
    )

    def vectors(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            rows = [np.flatnonzero(c).astype(np.int32) for c in map(counts_of, texts)]
            values = [counts_of(t)[r] for t, r in zip(texts, rows, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary()),
                 pa.array([v.astype(np.int32).tobytes() for v in values], pa.binary())],
                names=["lang", "dims", "counts"],
            )

    def means(frame):
        import pandas as pd

        counts = np.zeros((len(frame), DIMS), np.int64)
        for i, (d, c) in enumerate(zip(frame["dims"], frame["counts"], strict=True)):
            counts[i, np.frombuffer(d, np.int32)] = np.frombuffer(c, np.int32)
        found, floors = spherical_means(unit_rows(counts, idf), centroids, miss)
        return pd.DataFrame({
            "lang": frame["lang"].iloc[0], "mean": [m.astype(np.float32).tobytes() for m in found],
            "floor": [float(x) for x in floors],
        })

    drawn = stage(some.mapInArrow(vectors, "lang string, dims binary, counts binary"))
    rows = sorted(drawn.groupBy("lang").applyInPandas(means, "lang string, mean binary, floor double").collect())
    if not rows:
        return None
    return Model(
        idf, [r.lang for r in rows], np.stack([np.frombuffer(r.mean, np.float32) for r in rows]),
        np.array([r.floor for r in rows]),
    )


def _guesses(texts: list[bytes], model: Model | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """lang_pred, score and rejected of each text."""
    if model is None:
        return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    lettered = np.array([has_letter(t) for t in texts])
    cosines = unit_rows(np.stack([counts_of(t) for t in texts]), model.idf) @ model.means.T
    best = cosines.argmax(axis=1)
    score = np.clip(cosines[np.arange(len(texts)), best].astype(float), 0, 1) * lettered
    langs = [model.langs[b] if x else "und" for b, x in zip(best, lettered, strict=True)]
    return langs, score, ~lettered | (score < model.floors[best])


def predict(rows: DataFrame, model: Model | None) -> DataFrame:
    """The first column of (any, text), lang_pred, score and rejected, from the text alone."""
    name, kind = rows.columns[0], rows.schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                langs, score, out = _guesses([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()], model)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(out)],
                    names=[name, "lang_pred", "score", "rejected"],
                )

    return rows.mapInArrow(run, f"`{name}` {kind}, lang_pred string, score double, rejected boolean")


def accepted(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", centroids: int = 3, sample: int = 400
) -> DataFrame:
    """The rows of docs that are not rejected, whole: each row is judged by its own text, in one pass without a join."""
    model = fit(training_rows(docs, id_col, text_col, lang_col), centroids, sample)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).cast("string").alias("text"))
    return predict(rows, model).filter(~F.col("rejected")).select("row.*")


def fold(id_col: str, folds: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def training_rows(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int = 3, held: int = 1
) -> DataFrame:
    return (
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
            F.col(lang_col).cast("string").alias("lang"),
        )
        .filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", folds) != held))
    )


def identify_languages(
    docs: DataFrame, centroids: int = 3, sample: int = 400, folds: int = 3, held: int = 1,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row. A row without an id is held out."""
    model = fit(training_rows(docs, id_col, text_col, lang_col), centroids, sample)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).cast("string").alias("text"))
    return predict(rows, model).filter(~F.col("rejected")).select("row.*")


def fold(id_col: str, folds: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def training_rows(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int = 3, held: int = 1
) -> DataFrame:
    return (
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
            F.col(lang_col).cast("string").alias("lang"),
        )
        .filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", folds) != held))
    )


def identify_languages(
    docs: DataFrame, centroids: int = 3, sample: int = 400, folds: int = 3, held: int = 1,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row. A row without an id is held out."""
    train = (
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
            F.col(lang_col).cast("string").alias("lang"),
        )
        .filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", folds) != held))
    )
    model = fit(training_rows(docs, id_col, text_col, lang_col, folds, held), centroids, sample)
    out = predict(text_rows(docs, id_col, text_col), model)
    return out.withColumn("held_out", F.coalesce(fold("doc_id", folds) == held, F.lit(True)))
