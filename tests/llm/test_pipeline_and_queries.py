"""The pipeline stage by stage, and the registered queries over a small table folder."""

from __future__ import annotations

import os
import random

import duckdb
import pytest
from corpus import ALNUM, frame, lower, odd_rows, words
from test_near_dedup import brute as near_brute

import corpus_pipeline as C
from tillfloor.llm import sharding
from tillfloor.llm.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    base = [words(rng, 80) for _ in range(30)]
    passage = words(rng, 30)
    rows = [(i, " ".join(w), "en", f"s{i % 3 and 1}") for i, w in enumerate(base)]
    rows += [(100 + i, " ".join([*w[:-1], "other"]), "en", "s1") for i, w in enumerate(base[:10])]
    rows += [(200 + i, " ".join(passage + words(rng, 60)), "en", "s0") for i in range(4)]
    rows += [(i, t, None, None) for i, t in ((300, None), (301, ""), (302, "123 !!"), (6, rows[6][1]), (None, " ".join(words(rng, 80))))]
    path = str(tmp_path_factory.mktemp("tables"))
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars", "shard", "kept")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, rows, passage


def test_stages(spark, folder):
    path, docs, rows, passage = folder
    columns = docs.columns
    ids = lambda d: sorted((r.doc_id for r in d.select("doc_id").collect()), key=str)
    named = C.with_language(spark, docs, path)
    assert named.columns == columns and set(ids(docs)) - set(ids(named)) == {300, 301, 302}
    single = C.deduplicated(spark, named, path)
    kept = {i for i, _, _, ok in near_brute([(r[0], r[1]) for r in rows if r[0] not in (300, 301, 302)], 5) if ok}
    assert single.columns == columns and ids(single) == sorted([*kept, None], key=str)
    clean = C.decontaminated(spark, single, path)
    held = " ".join(passage)
    assert clean.columns == columns
    assert {i for i in ids(single)} - set(ids(clean)) == {r[0] for r in rows if r[1] and held in r[1]}
    mixed = C.mixed(spark, clean, path)
    assert mixed.columns == columns and set(ids(mixed)) <= set(ids(clean))
    out = C.sharded(spark, mixed, path)
    n = mixed.count()
    assert sorted((r["shard"], r["slot"]) for r in out.collect()) == sorted(sharding.place(i, n, C.SHARDS) for i in range(n))


def test_rows_are_judged_by_their_own_text(spark, folder):
    """Rows of one id with several texts, rows without an id, equal rows and a map column, in every stage."""
    path, _, rows, passage = folder
    rng = random.Random(8)
    held, clean = " ".join(passage + words(rng, 20)), " ".join(words(rng, 60))
    odd = [(700, clean), (700, "12 34 !!"), (None, "12 34 !!"), (None, held), (None, clean), (701, held), (701, clean + " x"), (702, clean), (702, clean)]
    full = [(*r, "en", "s", {"k": "v"}) if len(r) == 2 else (*r, {"k": "v"}) for r in odd + rows]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, extra map<string,string>")
    mine = lambda d: sorted(((r.doc_id, r.text) for r in d.collect() if (r.doc_id, r.text) in odd), key=str)
    named = C.with_language(spark, docs, path)
    assert named.columns == docs.columns and mine(named) == sorted((r for r in odd if "!!" not in r[1]), key=str)
    free = C.decontaminated(spark, named, path)
    assert mine(free) == sorted((r for r in odd if "!!" not in r[1] and held not in r[1]), key=str)
    single = C.deduplicated(spark, free, path)
    assert mine(single) == sorted([(700, clean), (None, clean)], key=str)
    several = spark.createDataFrame([(*r, "en", "s", None) for r in ((1, held), (1, clean), (2, None), (2, "a b"))], docs.schema)
    for _ in range(2):
        got = {r.doc_id: r.text for r in C.deduplicated(spark, several.repartition(3), path).collect()}
        own = spark.createDataFrame([(1, held), (1, clean)], "doc_id long, text string")
        assert got[2] is None and got[1] in (held, clean) and len(got) == 2
        assert {r.text for r in C.deduplicated(spark, own, path).collect()} == {got[1]}


def test_run_is_the_stages(spark, folder):
    path, docs, _, _ = folder
    want = docs
    for _, step in C.STAGES:
        want = step(spark, want, path)
    assert sorted(map(str, C.run(spark, path).collect())) == sorted(map(str, want.collect()))
    assert 4 <= len(C.STAGES) <= 5 and C.ORACLE_SQL is None


def test_an_empty_table_runs_through(spark, tmp_path, folder):
    folder[1].limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder[0]}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        at = f"{DATA}/{table}.parquet"
        con.execute(f"create view {table} as select * from '{at + '/*' if os.path.isdir(at) else at}'")
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, DATA).toPandas()[list(want.columns)]
    assert sorted(map(str, got.itertuples(index=False))) == sorted(map(str, want.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_cover_their_whole_table(spark, name):
    table, key = ("conversations", "conv_id") if name == "op11_conversation_repair" else ("documents", "doc_id")
    given = spark.read.parquet(f"{DATA}/{table}.parquet").select(key)
    rows = QUERIES[name](spark, DATA)
    if name not in ("op6_mixing", "op9_repeated_passages", "op13_lexical_search"):
        assert rows.count() == (given.distinct() if table == "conversations" else given).count()
    assert {r[0] for r in rows.select(key).collect()} <= {r[0] for r in given.collect()}
    assert ALNUM.findall(lower("A1-É")) == ["a1", "É"] and odd_rows()
