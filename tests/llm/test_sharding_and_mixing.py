from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from corpus import frame, odd_rows

from tillfloor.llm import mixing, sharding


@pytest.mark.parametrize("n", [1, 2, 3, 7, 24, 25, 100, 1009, 4096])
def test_the_network_permutes(n):
    assert sorted(sharding.permuted(x, n) for x in range(n)) == list(range(n))


@pytest.mark.parametrize("n", [1, 5, 23, 24, 100, 577])
def test_shards_are_those_of_the_row_numbers(spark, n):
    rng = random.Random(n)
    ids = rng.sample(range(10 * n), n)
    got = sharding.shard(frame(spark, [(i, "t") for i in ids]), ["doc_id"], 24).collect()
    want = {i: sharding.place(k, n, 24) for k, i in enumerate(sorted(ids))}
    assert {r.doc_id: (r["shard"], r["slot"]) for r in got} == want
    sizes = Counter(r["shard"] for r in got)
    assert n < 24 or max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))


def test_odd_rows_keep_their_columns(spark):
    docs = frame(spark, odd_rows())
    out = sharding.shard(docs, ["doc_id", "text"], 3)
    assert sorted(out.columns) == sorted(docs.columns) and out.count() == len(odd_rows())
    assert sharding.shard(frame(spark, []), ["doc_id"], 3).collect() == []


def corpus(rng):
    rows = []
    for source, n in (("hot", 300), ("mid", 80), ("small", 20), (None, 10)):
        rows += [(len(rows) + i, " ".join(["w"] * rng.randrange(1, 40)), "en", source) for i in range(n)]
    return rows


def test_weights_meet_the_entropy(spark):
    rows = corpus(random.Random(2))
    _, weights = mixing.mix(frame(spark, rows), entropy=0.9, repeats=1e9)
    w = {r.source_: r.weight for r in weights.collect()}
    assert sum(w.values()) == pytest.approx(1.0)
    assert -sum(x * math.log(x) for x in w.values()) == pytest.approx(0.9 * math.log(4), abs=1e-6)


def test_budget_is_met_in_every_source(spark):
    rows = corpus(random.Random(3)) + [(900, None, "en", "hot"), (901, "", "en", "mid"), (902, "a b", "en", "none"), (902, "a b", "en", "none")]
    docs = frame(spark, rows)
    read, weights = mixing.mix(docs, entropy=0.95, repeats=2.0)
    assert read.columns == docs.columns
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    source = {i: s for i, _, _, s in rows}
    total = sum(len((t or "").split()) for _, t, *_ in rows)
    got = Counter()
    times = Counter(r.doc_id for r in read.collect())
    for i, n in times.items():
        got[source[i]] += n * size[i]
    for r in weights.collect():
        name = r.source_[1:] if r.source_ else None
        assert r.repeat <= 2.0 + 1e-6
        assert abs(got[name] - r.weight * total) <= 40, (name, got[name], r.weight * total)
    assert max(n for i, n in times.items() if i != 902) <= 2
    again = Counter(r.doc_id for r in mixing.mix(docs.repartition(7), entropy=0.95, repeats=2.0)[0].collect())
    assert again == times


def test_nothing_to_weigh(spark):
    assert mixing.mix(frame(spark, []))[0].collect() == []
    docs = frame(spark, [(1, None, None, "a"), (2, "", None, "b")])
    assert sorted(r.doc_id for r in mixing.mix(docs)[0].collect()) == [1, 2]
    assert mixing.mix(frame(spark, odd_rows()))[0].count() == len(odd_rows())
