"""Holds registered queries against their SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb


def connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, float):
        return repr(0.0 if x == 0 else x)
    if isinstance(x, decimal.Decimal):
        return f"d{x.normalize():f}" if x else "d0"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return repr(x)


#: Types that must be alike on both sides.
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "smallint": "SMALLINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def differences(spark, con, query, sql: str, sf_dir: str) -> list[str]:
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(tuple(plain(x) for x in r) for r in df.select(*[f"`{n}`" for n in names]).collect())
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return [f"columns {names} and {sorted(rel.columns)}"]
    kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    wrong = [f"{n}: {k} and {kinds[n]}" for n, k in df.dtypes if KINDS.get(k, kinds[n]) != kinds[n]]
    at = [rel.columns.index(n) for n in names]
    want = sorted(tuple(plain(r[k]) for k in at) for r in rel.fetchall())
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        wrong.append(f"{len(got)} and {len(want)} rows; only here {sorted(a)[:3]}, only there {sorted(b)[:3]}")
    return wrong
