"""Quality rules with risk-controlled thresholds.

Each document has four ratios: characters a word, symbols a word, the share of
lines that repeat, the share of words in repeated five-word windows. For each
stratum (language) and ratio, the cutoff is the lowest one of a fixed grid at
which, on labelled documents, an exact (Clopper-Pearson) upper bound of the
share of good documents that it would reject stays within `risk`. All bounds
hold at once with probability 1 - `miss`: the miss probability is divided by the number
of strata and ratios. Grid points need no share of their own: they are tested in a fixed order, from the highest cutoff down,
until the first that fails, so a wrong one is proven only where the first wrong one is. A stratum with too few labels to prove
any cutoff rejects nothing beyond the base rules.

Null or empty texts have no words and fail the base rule. A document with a null or
unseen stratum uses the cutoffs of no stratum: base rules only. Repeated label rows
of one document count once; it is good if no row of it says otherwise. Repeated
documents each get their row. Columns beyond id, text and stratum are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillfloor.llm.common import shingle_hashes, word_hashes

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
RATIOS = ("chars_per_word", "symbol_share", "dup_line_share", "repeat_share")
#: Grid of cutoffs: steps of each ratio's scale. A ratio at or above a cutoff's step is rejected.
GRID = 64
SCALES = {"chars_per_word": 32.0, "symbol_share": 1.0, "dup_line_share": 1.0, "repeat_share": 1.0}
COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def counts_of(text: bytes) -> tuple[int, int, int, int, int, int]:
    words = text.split()
    joined = b"".join(words)
    # a code point has one byte that is no continuation byte
    data = np.frombuffer(joined, np.uint8)
    chars = int(np.count_nonzero((data & 0xC0) != 0x80))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(words), chars, symbols, len(lines), len(lines) - len(set(lines)), repeated(text, len(words))


def repeated(text: bytes, n: int) -> int:
    """Words within five-word windows that stand twice or more in the text."""
    if n <= WINDOW:
        return 0
    windows = shingle_hashes(word_hashes(text), WINDOW)
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    hits = np.flatnonzero(times[which] > 1)
    if not len(hits):
        return 0
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, hits, 1)
    np.add.at(marks, hits + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(marks[:-1])))


def upper_bound(bad: int, n: int, miss: float) -> float:
    """Clopper-Pearson: the largest share under which `bad` or fewer of n have probability `miss`."""
    if bad >= n:
        return 1.0
    low, high = bad / n, 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(bad + 1)]
    for _ in range(60):
        p = (low + high) / 2
        terms = [c + i * math.log(p) + (n - i) * math.log1p(-p) for i, c in enumerate(logs)] if p < 1 else [-1e9]
        top = max(terms)
        if top + math.log(sum(math.exp(t - top) for t in terms)) > math.log(miss):
            low = p
        else:
            high = p
    return high


def with_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum and the counts of every row; one pass, no shuffle."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.col(stratum_col).cast("string").alias("stratum"),
    )

    def run(batches):
        import pyarrow as pa

        names = [x.strip().split(" ")[0] for x in COUNTS.split(",")]
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [counts_of(t or b"") for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), *(pa.array(c, pa.int64()) for c in zip(*found, strict=True))],
                    names=["doc_id", "stratum", *names],
                )

    counted = rows.mapInArrow(run, f"doc_id long, stratum string, {COUNTS}")
    n = F.greatest(F.col("n_words"), F.lit(1))
    values = {
        "chars_per_word": F.col("word_chars") / n,
        "symbol_share": F.col("n_symbols") / n,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / n,
    }
    steps = {
        f"{k}_step": F.least(F.floor(v * GRID / SCALES[k]), F.lit(GRID)).cast("int") for k, v in values.items()
    }
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumns({**steps, "base_failed": failed})


def thresholds(counted: DataFrame, labels: DataFrame, risk: float = 0.01, miss: float = 0.05) -> DataFrame:
    """The proven cutoff step of each (stratum, ratio): rows stratum, then one column a ratio.

    The labelled good documents are counted by grid step, so a stratum costs at most
    GRID + 1 rows a ratio whatever its size; the bounds are then found group by group.
    """
    good = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("quality"))
        .filter(F.col("quality") == 1)
        .select("doc_id")
    )
    steps = F.explode(
        F.array(*(F.struct(F.lit(r).alias("ratio"), F.col(f"{r}_step").alias("step")) for r in RATIOS))
    )
    hist = (
        counted.filter(F.col("stratum").isNotNull() & ~F.col("base_failed"))
        .join(good, "doc_id", "left_semi")
        .select("stratum", steps.alias("x"))
        .groupBy("stratum", "x.ratio", "x.step")
        .count()
    )
    # one (stratum, ratio) has at most GRID + 1 rows here
    from_top = Window.partitionBy("stratum", "ratio").orderBy(F.desc("step"))
    whole = Window.partitionBy("stratum", "ratio")
    tails = hist.select(
        "stratum", "ratio", "step", F.sum("count").over(from_top).alias("rejected"), F.sum("count").over(whole).alias("n")
    )
    strata = hist.agg(F.count_distinct("stratum")).first()[0]
    tests = max(1, strata) * len(RATIOS)

    def cut(frame):
        import pandas as pd

        frame = frame.sort_values("step", ascending=False)
        best = GRID + 1 if upper_bound(0, int(frame["n"].iloc[0]), miss / tests) > risk else None
        if best is None:
            # a cutoff just above the largest step seen rejects no labelled good document
            best = int(frame["step"].iloc[0]) + 1
            for step, rejected, n in zip(frame["step"], frame["rejected"], frame["n"], strict=True):
                if upper_bound(int(rejected), int(n), miss / tests) > risk:
                    # between this step and the last proven one no labelled good document lies
                    best = int(step) + 1
                    break
                best = int(step)
        return pd.DataFrame({"stratum": [frame["stratum"].iloc[0]], "ratio": [frame["ratio"].iloc[0]], "cutoff": [best]})

    cuts = tails.groupBy("stratum", "ratio").applyInPandas(cut, "stratum string, ratio string, cutoff int")
    return cuts.groupBy("stratum").agg(
        *(F.max(F.when(F.col("ratio") == r, F.col("cutoff"))).alias(f"{r}_cutoff") for r in RATIOS)
    )


def verdicts(counted: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Adds kept: the base rules hold and no ratio reaches its stratum's cutoff."""
    joined = counted.join(cutoffs, "stratum", "left")
    over = F.lit(False)
    for r in RATIOS:
        over = over | F.coalesce(F.col(f"{r}_step") >= F.col(f"{r}_cutoff"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~over)


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.01, miss: float = 0.05, stratum_col: str = "lang") -> DataFrame:
    """Counts, base_failed and kept for every row of docs."""
    from tillfloor.llm.common import stage

    counted = stage(with_counts(docs, stratum_col=stratum_col))
    cutoffs = stage(thresholds(counted, labels, risk, miss))
    return verdicts(counted, cutoffs)
