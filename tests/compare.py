"""Compare a Spark result with an SQL result: names, row count and sorted values."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def sql_connection(data: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def _value(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return f"b{int(v)}"
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float) and not math.isnan(v) and v == int(v) and abs(v) < 1e15:
        v = int(v)
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return str(v)


def normalise(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_value(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty when the two results are the same."""
    got_cols, got = normalise(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_cols, want = normalise([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return [f"columns {got_cols} != {want_cols}"]
    if len(got) != len(want):
        return [f"rows {len(got)} != {len(want)}"]
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return [f"{len(bad)} of {len(got)} rows differ, first {g} != {w}" for g, w in bad[:1]]
