from __future__ import annotations

import random

import pytest
from corpus import SPACED, frame, lower, odd_rows, words

from tillfloor.llm import near_dedup as N
from tillfloor.llm.components import components


def shingles(text, k):
    w = SPACED.findall(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(docs, k, t=80):
    sets = {i: shingles(text, k) for i, text in docs if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if both and 100 * both >= t * (len(x) + len(y) - both):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def near_copies(rng, n, base, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = "".join(rng.choice("xyz") for _ in range(6))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k", [4, 5])
def test_against_brute_force(spark, k):
    rng = random.Random(k)
    texts = []
    for size, edits, n in ((60, 2, 40), (120, 8, 30), (30, 1, 25), (200, 14, 20), (8, 1, 12)):
        texts += near_copies(rng, n, words(rng, size), edits)
    texts += [" ".join(words(rng, 50)) for _ in range(40)]
    docs = odd_rows() + [(100 + i, t) for i, t in enumerate(texts)] + [(500 + i, texts[0]) for i in range(60)]
    rng.shuffle(docs)
    got = sorted(map(tuple, N.near_duplicates(frame(spark, docs), k=k).collect()))
    assert got == brute(docs, k)


def test_more_members_than_centres(spark):
    """A bucket of many near copies: rounds go on until one component is left."""
    rng = random.Random(9)
    docs = list(enumerate(near_copies(rng, 120, words(rng, 150), 3)))
    got = N.near_duplicates(frame(spark, docs)).collect()
    assert sorted(map(tuple, got)) == brute(docs, 5)


def test_an_id_with_two_texts_is_one_document(spark):
    rows = N.near_duplicates(frame(spark, [(1, "a b c d e f"), (1, "u v w x y z"), (2, "a b c d e f")])).collect()
    assert sorted(r.doc_id for r in rows) == [1, 2]


def test_empty_table(spark):
    assert N.near_duplicates(frame(spark, [])).collect() == []


def test_bounds_keep_a_pair_at_the_threshold():
    for n, need in N.least_matches(0.8, N.MISS):
        from math import comb

        assert sum(comb(n, i) * 0.8**i * 0.2 ** (n - i) for i in range(need)) < 1e-5


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(300, 301), (5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert {got[i] for i in range(100, 161)} == {100}
    assert {got[i] for i in range(200, 260)} == {7} and got[301] == 300 and 5 not in got
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def crowd(rng, n, planted):
    """n texts of one 40-word core each with 14 words of their own (similarity 0.5 to 0.7), and planted pairs at 0.8 or more."""
    core = words(rng, 40)
    out = [" ".join(core[:20] + words(rng, 7) + core[20:] + words(rng, 7)) for _ in range(n)]
    for i in rng.sample(range(n), planted):
        w = out[i].split()
        w[-1] = "planted"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [N.BLOCK, 16])
def test_a_deep_bucket_of_unlinked_texts_loses_no_link(spark, monkeypatch, block):
    """Blocks of 16 make hundreds of meetings of blocks and rounds of centres that link next to nothing."""
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "PAIRS", 1000)
    rng = random.Random(block)
    docs = list(enumerate(crowd(rng, 300, 30)))
    docs += [(1000 + i, t) for i, t in enumerate(near_copies(rng, 60, words(rng, 150), 3))]
    got = sorted(map(tuple, N.near_duplicates(frame(spark, docs), k=2).collect()))
    want = brute(docs, 2)
    assert got == want and sum(not kept for *_, kept in want) >= 30 + 59


def test_pairs_of_a_run_are_those_of_its_key():
    """Runs over several batches, sides, components and sizes, against every pair."""
    import pyarrow as pa

    rng = random.Random(4)
    names = [x.split()[0] for x in N.MEET.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    rows = sorted(
        (rng.randrange(12), rng.choice((-1, 0, 1)), 0, i, rng.randrange(30), rng.choice((10, 100)), bytes(N.HASHES)) for i in range(90)
    )
    rows = [(k, -1 if k % 2 else abs(s), *r) for k, s, *r in rows]
    parts = [rows[i : i + 7] for i in range(0, len(rows), 7)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*p, strict=True), kinds, strict=True)], names=names) for p in parts]
    found = set()
    for run in N._runs(iter(batches)):
        node = run.column(3).to_numpy()
        for i, j, _ in N._survivors(run, N.least_matches(0.8, N.MISS), 80):
            found |= set(zip(node[i].tolist(), node[j].tolist(), strict=True))
    want = {
        (a[3], b[3]) for x, a in enumerate(rows) for b in rows[x + 1 :]
        if a[0] == b[0] and (a[1] < 0 or a[1] != b[1]) and a[4] != b[4] and a[5] == b[5]
    }
    assert found == want
