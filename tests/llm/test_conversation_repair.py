from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pytest

from tillfloor.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string, cost long, block string, conv long"
WHITE = " \t\n\x0b\x0c\r"


def harm(rows):
    """The damage of the contract, row by row."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def plain(rows):
    """Whole audits as strings, every edit and insert at every place: (cost, audit, lines) of the least."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    def inserted(ways):
        """Ways and those with up to three inserts after them."""
        out = dict(ways)
        for _ in range(3):
            for state, (cost, audit, lines) in list(out.items()):
                for to in after[state]:
                    if to != "s":
                        way = (cost + 3, audit + "I", (*lines, full[to] + ":"))
                        out[to] = min(out.get(to, way), way)
        return out

    ways = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}

        def add(state, way):
            new[state] = min(new.get(state, way), way)  # noqa: B023

        for state, (cost, audit, lines) in inserted(ways).items():
            add(state, (cost + 4, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] and role[:1] in after[state]:
                    add(role[:1], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                for to in after[state]:
                    if to != "s":
                        add(to, (cost + more + 3, audit + "R", (*lines, f"{full[to]}:{text}")))
        ways = new
    cost, audit, lines = min(w for s, w in inserted(ways).items() if s in ("", "a"))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), pairs, cost, audit, sha


def conversation(rng, conv, n):
    roles = ["system", "user", "assistant", "assistant", "user", "tool", "", None, "User"]
    texts = ["Yes.", "no", "What?", " \n", "", None, "a\nb!", "à.", "x. \t", "...", "same text."]
    return [
        (conv, rng.choice([None, *range(n)]) if rng.random() < 0.15 else t, rng.choice(roles[: rng.choice((3, 5, 9))]), rng.choice(texts) if rng.random() < 0.5 else f"t{rng.randrange(50)}.")
        for t in range(n)
    ]


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(11)
    rows = [r for conv in range(60) for r in conversation(rng, conv, rng.randrange(1, 9))]
    rows += [r for conv in (100, 101, None) for r in conversation(rng, conv, 60)]
    rows += [(200, 5, "user", "again and again.")] * 30 + [(201, None, None, None)] * 3
    rows += [(300 + i, 0, "user", "x.") for i in range(120)]  # some of these are dropped, and the conversation is empty
    rng.shuffle(rows)
    return rows


def result(spark, rows, **kw):
    frame = spark.createDataFrame([(*r, -1, "junk", 5) for r in rows], SCHEMA)
    return {r[0]: tuple(r)[1:] for r in C.repaired_conversations(frame, **kw).collect()}


@pytest.mark.parametrize("block", [C.BLOCK, 4])
def test_against_plain_search(spark, talks, block):
    """Blocks of four rows take nearly every conversation apart."""
    want = {conv: plain(rows) for conv, rows in harm(talks).items()}
    got = result(spark, talks, block=block)
    assert got.keys() == want.keys()
    assert {c: (got[c], want[c]) for c in want if got[c] != want[c]} == {}
    assert any(want[c][6] == "" for c in range(300, 420))


def test_against_sql(spark, talks, tmp_path):
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{path}/*.parquet'")
    assert {r[0]: r[1:] for r in con.execute(C.ORACLE).fetchall()} == result(spark, talks)


def test_random_small_conversations_without_spark():
    rng = random.Random(5)
    for i in range(1500):
        rows = sorted(((t, r or " ", x or " ") for _, t, r, x in conversation(rng, i, rng.randrange(1, 10))), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        assert C.repaired([(*r, 1) for r in rows]) == plain(rows)


def test_equal_hashes_are_verified(monkeypatch):
    """Without hashes worth the name every comparison is by labels."""
    monkeypatch.setattr(C.Prefixes, "code", staticmethod(lambda label: 1))
    test_random_small_conversations_without_spark()


def test_first_difference_on_long_paths():
    prefixes, rng = C.Prefixes(), random.Random(3)
    for n in (1, 2, 7, 64, 500):
        a = [rng.choice("DKR") for _ in range(n)]
        at = rng.randrange(n)
        b = [*a[:at], "IK", *(rng.choice("DKR") for _ in range(n - at - 1))]
        x = y = C.Prefixes.ROOT
        for p, q in zip(a, b, strict=True):
            x, y = prefixes.add(x, p), prefixes.add(y, q)
        assert prefixes.less(x, "", y, "") == (a < b) and prefixes.path(x) == a
        u, v = prefixes.first_difference(x, y)
        assert (prefixes.labels[u], prefixes.labels[v]) == (a[at], "IK")


def test_empty_table(spark):
    assert result(spark, []) == {}
