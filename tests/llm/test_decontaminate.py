from __future__ import annotations

import hashlib
import random

import duckdb
import pytest
from corpus import ALNUM, frame, lower, odd_rows, words

from tillfloor.llm import decontaminate as D


def brute(docs, items, width=13):
    windows: dict[tuple, set[str]] = {}
    for item_id, text in items:
        w = ALNUM.findall(lower(text))
        if item_id is not None and w:
            k = min(width, len(w))
            for s in range(len(w) - k + 1):
                windows.setdefault(tuple(w[s : s + k]), set()).add(str(item_id))
    sizes = {len(x) for x in windows}
    out = []
    for doc_id, text in docs:
        w = ALNUM.findall(lower(text))
        hit, found = set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                if (own := windows.get(tuple(w[s : s + k]))) is not None:
                    hit.update(range(s, s + k))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(spark, docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.digest(D.decontaminate(frame(spark, docs), bench)).drop("n_near_items").collect()
    return sorted((tuple(r) for r in got), key=str)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(5)
    items = [(i, " ".join(words(rng, rng.choice([3, 12, 13, 14, 40])))) for i in range(30)]
    items += [(30, None), (31, ""), (None, "an item without id"), (32, items[0][1]), (0, items[0][1]), (33, "the the the the")]
    docs = odd_rows()
    for i in range(60):
        w = words(rng, rng.randrange(0, 200))
        for _ in range(rng.randrange(3)):
            own = ALNUM.findall(rng.choice(items[:30])[1])
            cut = own[rng.randrange(2) :] if rng.random() < 0.5 else own
            at = rng.randrange(len(w) + 1)
            w[at:at] = cut
        docs.append((100 + i, (", " if i % 2 else " ").join(w).upper() if i % 5 == 0 else " ".join(w)))
    docs.append((300, "the the the the the x the the the"))
    return docs, items


def test_against_brute_force(spark, cases):
    docs, items = cases
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark, cases):
    docs, items = cases
    assert run(spark, [], items) == []
    assert run(spark, docs[:4], []) == brute(docs[:4], [])


def test_proximity(spark):
    item = "zeta yoke xray wolf vine"
    found = D.decontaminate(
        frame(spark, [(1, item), (2, "zeta yoke xray wolf and vine"), (3, "zeta other words")]),
        spark.createDataFrame([(1, item)], "item_id long, text string"), slack=2,
    ).collect()
    assert {r.doc_id: (r.n_hit, r.n_near_items) for r in found}[1] == (5, 1)
    assert {r.doc_id: r.n_hit for r in found}[2] == 0
    assert {r.doc_id: r.n_near_items for r in found}[3] == 0


def test_near_items_have_all_words_of_a_window_near(spark):
    item = "zeta yoke xray wolf vine"
    docs = [
        (1, item), (2, "zeta yoke xray wolf and vine"), (3, "zeta other words"), (4, "the rarest two: wolf vine"), (5, "zeta yoke xray"),
        (8, "zeta yoke xray"),
        (6, "zeta yoke xray wolf and then so on vine"), (7, "a zeta the yoke xray wolf vine"),
    ]
    found = D.decontaminate(frame(spark, docs), spark.createDataFrame([(1, item)], "item_id long, text string"), slack=2).collect()
    assert {r.doc_id: r.n_near_items for r in found} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 1, 8: 0}


def test_sql_gives_the_same(spark, cases):
    docs, items = cases
    docs = [d for d in docs if d[0] not in (None, 6)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar); create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    con.executemany("insert into benchmark values (?, ?)", [i for i in items if i[1] is not None])
    assert sorted(map(tuple, con.execute(D.ORACLE).fetchall()), key=str) == brute(docs, items)
