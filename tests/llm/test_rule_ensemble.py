from __future__ import annotations

import math
import os
import random
import zlib

import pytest
from corpus import SPACED, frame, odd_rows, words
from pyspark.sql import functions as F

from tillfloor.llm import rule_ensemble as R

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def good(rng):
    return ". ".join(" ".join(words(rng, 12)).capitalize() for _ in range(rng.randrange(3, 8))) + "."


def bad(rng):
    return " | ".join(words(rng, rng.randrange(20, 60))) if rng.random() < 0.5 else " ".join(words(rng, 4) * 12)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(400):
        label = int(rng.random() < 0.7)
        docs.append((i, good(rng) if label else bad(rng), "en", "s"))
        labels.append((i, label, 0))
    docs += [(i + 10_000, *row[1:], None, None)[:4] for i, row in enumerate(odd_rows())]
    return frame(spark, docs), labels


def label_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def by_hand(rule, row):
    return all(row[n] <= bound if side == "<=" else row[n] > bound for n, side, bound in rule)


def test_compiled_rules_score_as_by_hand_and_weights_are_sparse(spark, labelled):
    docs, labels = labelled
    found = R.stage(R.described(docs))
    rows = R.training_rows(found, label_frame(spark, labels))
    intercept, weighted = R.fit(rows)
    assert 0 < len(weighted) < 56  # a tree of depth 3 has 14 paths; eight such trees have 112
    for row in found.withColumn("score", R.score_column(intercept, weighted)).collect():
        total = intercept + sum(w for rule, w in weighted if by_hand(rule, row))
        assert math.isclose(row["score"], 1 / (1 + math.exp(-total)), rel_tol=1e-12)


def test_held_out_rows_are_told_apart(spark, labelled):
    docs, labels = labelled
    got = {r.doc_id: r for r in R.quality_scores(docs, label_frame(spark, labels)).collect()}
    held = [(got[i].predicted, label) for i, label, _ in labels if got[i].held_out]
    assert len(held) > 80 and sum(p == label for p, label in held) >= 0.97 * len(held)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.values())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark, labelled):
    docs, labels = labelled
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, 1 - t) for i, q, t in labels]
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string"), "n_words": F.lit(5)})
    first = sorted((str(r.doc_id), r.score) for r in R.quality_scores(docs, label_frame(spark, labels)).collect())
    assert first == sorted((str(r.doc_id), r.score) for r in R.quality_scores(other, label_frame(spark, turned)).collect())


def test_statistics_of_a_text():
    text = "One two, TWO!\n| a | b1 |\n| a | b1 |\n"
    got = dict(zip(R.STATISTICS, R.statistics()(text.encode()), strict=True))
    w = SPACED.findall(text)
    assert got["n_words"] == len(w) and got["lines"] == 3 and got["longest_word"] == 4
    assert got["word_chars"] == round(sum(map(len, w)) / len(w), 4) and got["pipe_share"] == round(6 / len(w), 4)
    assert got["dup_line_share"] == round(1 / 3, 4) and got["distinct_share"] == round(6 / len(w), 4)
    assert R.statistics()(b" \n") == R.statistics()(b"") == (0.0,) * len(R.STATISTICS)


def test_paths_of_a_printed_tree():
    names = ("x", "y")
    text = """GBTClassificationModel
  Tree 0 (weight 1.0):
    If (feature 0 <= 1.5)
     If (feature 1 <= -2.0E-4)
      Predict: 1.0
     Else (feature 1 > -2.0E-4)
      Predict: 0.0
    Else (feature 0 > 1.5)
     If (feature 0 <= 3.0)
      Predict: 0.0
     Else (feature 0 > 3.0)
      Predict: 1.0
  Tree 1 (weight 0.1):
    Predict: 0.5
"""
    assert set(R.paths(text, names)) == {
        (("x", "<=", 1.5),), (("x", ">", 1.5),), (("x", "<=", 1.5), ("y", "<=", -0.0002)),
        (("x", "<=", 1.5), ("y", ">", -0.0002)), (("x", "<=", 3.0), ("x", ">", 1.5)), (("x", ">", 3.0),),
    }


def test_few_labels_and_empty_tables(spark, labelled):
    docs = labelled[0].limit(5)
    assert {r.score for r in R.quality_scores(docs, label_frame(spark, [])).collect()} == {0.5}
    one = R.quality_scores(docs, label_frame(spark, [(i, 1, 0) for i in range(9)] + [(None, 0, 0), (3, None, 0)])).collect()
    assert len({r.score for r in one}) == 1 and one[0].score > 0.5
    assert R.quality_scores(labelled[0].limit(0), label_frame(spark, [(1, 1, 0)])).collect() == []


def test_held_out_accuracy_on_the_given_tables(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    scored = R.quality_scores(docs, labels).filter("held_out").join(labels.select("doc_id", "quality"), "doc_id")
    right, n = scored.agg(F.sum((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert right >= 0.95 * n
