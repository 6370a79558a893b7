from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from corpus import ALNUM, frame, lower, odd_rows, words

from tillfloor.llm import lexical_search as L


def brute(docs, items, k):
    """(item, rank, id, score) from every document and item."""
    bags = [(i, Counter(ALNUM.findall(lower(t)))) for i, t in docs if t]
    bags = [(i, b) for i, b in bags if b]
    n, length = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted: dict = {}
    for item, text in set(items):
        if item is not None and text:
            wanted.setdefault(item, Counter()).update(ALNUM.findall(lower(text)))
    out = []
    for item, own in wanted.items():
        ranked = []
        for i, b in bags:
            m = 25 + 75 * b.total() * n // length
            score = sum(
                c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m))
                for t, c in own.items() if t in b
            )
            if score > 0:
                ranked.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(ranked)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, **kw):
    query = spark.createDataFrame([(*x, "junk") for x in items], "item_id long, text string, score string")
    return sorted(map(tuple, L.search(frame(spark, docs), query, **kw).collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(13)
    lexicon = words(rng, 60)
    text = lambda n: " ".join(rng.choice(lexicon[: rng.choice((5, 60))]) for _ in range(n))
    docs = odd_rows() + [(100 + i, text(rng.randrange(1, 40))) for i in range(150)]
    same = text(12)
    # one bag: copies, other orders, other cases, and one with a word that no item asks for
    docs += [(900 - i, " ".join(rng.sample(same.split(), 12))) for i in range(40)] + [(50, same.upper())]
    docs += [(400 + i, same[: len(same) // 2] + " zz" + str(i)) for i in range(5)]
    items = [(i, text(rng.randrange(1, 15))) for i in range(20)] + [(30, same), (30, "À ñ"), (31, None), (None, same), (32, "!!"), (33, "zz9 nowhere")]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("k,block_words", [(10, 100_000), (3, 60)])
def test_against_brute_force(spark, corpus, k, block_words):
    docs, items = corpus
    assert found(spark, docs, items, k=k, block_words=block_words) == brute(docs, items, k)


def test_small_chunks_give_the_same(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(L, "CHUNK", 7)
    assert found(spark, docs, items) == brute(docs, items, 10)


def test_copies_are_one_class_and_come_by_id(spark):
    docs = [(i, "alpha beta") for i in range(300, 0, -1)] + [(0, "other words"), (None, "alpha beta"), (999, "beta alpha")]
    got = found(spark, docs, [(1, "alpha")])
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == list(range(1, 11)) and len({r[3] for r in got}) == 1
    index = {b"alpha": 0}
    rows = L.classes(L.bags(frame(spark, docs).select("doc_id", "text"), index), 303, 606)
    assert rows.groupBy(*L.CLASS).count().count() == 1


def test_a_null_id_comes_last_among_equals(spark):
    assert [r[2] for r in found(spark, [(None, "alpha x"), (5, "alpha x"), (6, "y y")], [(1, "alpha")])] == [5, None]


def test_empty_tables(spark):
    assert found(spark, [], [(1, "alpha")]) == [] and found(spark, [(1, "alpha")], []) == []
    assert found(spark, [(1, "")], [(1, "alpha")]) == []
