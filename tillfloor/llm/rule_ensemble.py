"""Quality classifier: a sparse ensemble of rules, compiled to Spark columns.

Each text is described by statistics (`STATISTICS`). Boosted trees are grown on the statistics of the labelled training rows;
every path from a root to an inner node or leaf is a rule, a conjunction of bounds on statistics. A logistic
regression with a lasso penalty weighs the rules, most get weight 0, and the others are compiled into one
Spark expression: score = 1 / (1 + exp(-(intercept + sum of the weights of the rules that hold))).

Trees and weights are fitted by Spark over all labelled rows that are not held out, as equal (statistics,
label) rows with their counts, so that a third of all rows being copies costs one row. Training never reads labels of rows whose
crc32(id) mod 3 is `held_out`; statistics depend on the text alone.

Null and empty texts have all statistics 0 and get the score of those. Label rows with a null id or label count
for nothing; of several label rows of one id, the lowest label counts. A null id has no label and is not held out. Repeated
documents each get their row. With labels of fewer than two classes there is no tree, and the score is the
share of 1 (0.5 without labels). Columns other than id and text are not read.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillfloor.llm.common import by_document, shingle_hashes, stage, text_rows, word_hashes

STATISTICS = (
    "n_words", "word_chars", "longest_word", "lines", "words_per_line", "symbol_share", "pipe_share", "shout_share",
    "capital_share", "digit_share", "punctuation_share", "wide_share", "end_share", "distinct_share", "top_share",
    "repeat_share", "dup_line_share", "short_line_share", "sentence_share", "glued_share",
)
SYMBOLS, ENDS = b"#*$%&|<>@^~=_\\{}[]", b".!?"
WINDOW = 5


def _byte_class(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(members, np.uint8)] = True
    return table


def statistics() -> object:
    """The function of one text: its statistics, in the order of STATISTICS, rounded so that equal texts stay equal."""
    symbol, end, digit = _byte_class(SYMBOLS), _byte_class(ENDS), _byte_class(b"0123456789")
    capital, small = _byte_class(bytes(range(65, 91))), _byte_class(bytes(range(97, 123)))
    mark = _byte_class(bytes(c for c in range(33, 127) if not chr(c).isalnum()))

    def each(text: bytes) -> tuple[float, ...]:
        words = text.split()
        n = len(words)
        if not n:
            return (0.0,) * len(STATISTICS)
        data = np.frombuffer(b"".join(words), np.uint8)
        size = len(data)
        chars = int(np.count_nonzero((data & 0xC0) != 0x80))
        last = np.frombuffer(b"".join(w[-1:] for w in words), np.uint8)
        letters = max(1, int(np.count_nonzero(capital[data] | small[data])))
        hashes = word_hashes(text.lower())
        _, times = np.unique(hashes, return_counts=True)
        lines = [x.strip() for x in text.split(b"\n") if x.strip()]
        twice = 0
        if n > WINDOW:
            _, which, seen = np.unique(shingle_hashes(hashes, WINDOW), return_inverse=True, return_counts=True)
            twice = np.count_nonzero(seen[which] > 1) / (n - WINDOW + 1)
        marks = np.frombuffer(b"".join(w[-2:-1] for w in words), np.uint8)
        values = (
            n, chars / n, max(map(len, words)), len(lines), n / len(lines), np.count_nonzero(symbol[data]) / size,
            np.count_nonzero(data == 0x7C) / n, np.count_nonzero(data == 0x21) / n, np.count_nonzero(capital[data]) / letters,
            np.count_nonzero(digit[data]) / size, np.count_nonzero(mark[data]) / size, np.count_nonzero(data >= 0x80) / size,
            np.count_nonzero(end[last]) / n, len(times) / n, times.max() / n, twice, 1 - len(set(lines)) / len(lines),
            sum(len(x) < 20 for x in lines) / len(lines), np.count_nonzero(end[last]) / len(lines),
            np.count_nonzero(mark[marks]) / n,
        )
        return tuple(round(float(v), 4) for v in values)

    return each


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of every row, in one pass without a shuffle."""
    return by_document(text_rows(docs, id_col, text_col), statistics, ", ".join(f"{s} double" for s in STATISTICS))


def is_held_out(doc_id: Column, of: int = 3, held_out: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == held_out, F.lit(False))


def training_rows(found: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(statistics, label, weight) of the labelled rows that are not held out; equal rows once, with their count."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label"))
        .filter("doc_id is not null and label in (0, 1)")
        .filter(~is_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )
    return found.join(known, "doc_id").groupBy(*STATISTICS, "label").agg(F.count("*").cast("double").alias("weight"))


Rule = tuple[tuple[str, str, float], ...]
_NODE = re.compile(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-0-9.Ee]+)\)")


def paths(description: str, names: tuple[str, ...] = STATISTICS) -> list[Rule]:
    """Every path of the trees in a model's printed form, as (statistic, <= or >, bound) in the order of names."""
    rules: set[Rule] = set()
    path: list[tuple[int, tuple[str, str, float]]] = []
    for line in description.splitlines():
        if node := _NODE.match(line):
            depth = len(node[1])
            path = [x for x in path if x[0] < depth] + [(depth, (names[int(node[2])], node[3], float(node[4])))]
            rules.add(simplified([x for _, x in path]))
        elif line.lstrip().startswith("Tree "):
            path = []
    return sorted(rules)


def simplified(conditions: list[tuple[str, str, float]]) -> Rule:
    """One bound a statistic and side, the tightest."""
    tight: dict[tuple[str, str], float] = {}
    for name, side, bound in conditions:
        old = tight.get((name, side), bound)
        tight[name, side] = min(old, bound) if side == "<=" else max(old, bound)
    return tuple(sorted((name, side, bound) for (name, side), bound in tight.items()))


def holds(rule: Rule) -> Column:
    return reduce(and_, (F.col(n) <= bound if side == "<=" else F.col(n) > bound for n, side, bound in rule))


def fit(rows: DataFrame, trees: int = 8, depth: int = 3, penalty: float = 0.002, seed: int = 12) -> tuple[float, list[tuple[Rule, float]]]:
    """The intercept and the rules with a weight other than 0."""
    rows = stage(rows)
    seen = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.sum("weight").alias("n")).collect()}
    if len(seen) < 2:
        # half a row of each label, so that the score stays within 0 and 1
        return float(np.log((seen.get(1.0, 0) + 0.5) / (seen.get(0.0, 0) + 0.5))) if seen else 0.0, []
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows)
    grown = GBTClassifier(
        maxIter=trees, maxDepth=depth, stepSize=0.3, weightCol="weight", minInstancesPerNode=2, seed=seed
    ).fit(vectors.select("features", "label", "weight"))
    rules = paths(grown.toDebugString)
    if not rules:
        return float(np.log(seen[1.0] / seen[0.0])), []
    columns = [holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)]
    # rows of one pattern of rules and label are one row
    names = [f"r{i}" for i in range(len(rules))]
    patterns = rows.select(*columns, "label", "weight").groupBy(*names, "label").agg(F.sum("weight").alias("weight"))
    marked = VectorAssembler(inputCols=names, outputCol="features").transform(stage(patterns))
    model = LogisticRegression(
        regParam=penalty, elasticNetParam=1.0, standardization=False, weightCol="weight", maxIter=60
    ).fit(marked.select("features", "label", "weight"))
    weights = model.coefficients.toArray()
    return float(model.intercept), [(r, float(w)) for r, w in zip(rules, weights, strict=True) if w]


def score_column(intercept: float, weighted: list[tuple[Rule, float]]) -> Column:
    """The compiled ensemble: an expression over the statistics."""
    total = reduce(lambda a, b: a + b, (F.when(holds(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in weighted), F.lit(intercept))
    return 1 / (1 + F.exp(-total))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs, beside its statistics."""
    found = stage(described(docs))
    intercept, weighted = fit(training_rows(found, labels, label), **options)
    scored = found.withColumn("score", score_column(intercept, weighted))
    return scored.withColumns({
        "held_out": is_held_out(F.col("doc_id")), "predicted": F.when(F.col("score") >= 0.5, 1).otherwise(0),
    })
