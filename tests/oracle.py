"""Compare a Spark query with its SQL run by DuckDB on the same tables."""

from __future__ import annotations

import datetime
import math
import pathlib

import duckdb


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(pathlib.Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def norm(v):
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("n", str(v))
    if isinstance(v, float):
        return ("f", "nan" if math.isnan(v) else repr(v))
    if isinstance(v, datetime.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    if v is None:
        return ("", "")
    return ("s", str(v))


def compare(df, con, sql: str) -> list[str]:
    """Differences as text; empty when equal."""
    rel = con.sql(sql)
    problems = []
    if sorted(df.columns) != sorted(rel.columns):
        return [f"columns {sorted(df.columns)} != {sorted(rel.columns)}"]
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    duck_types = dict(zip(rel.columns, map(str, rel.types)))
    for name, t in df.dtypes:
        if kinds.get(t) != duck_types[name]:
            problems.append(f"type of {name}: {t} != {duck_types[name]}")
    cols = sorted(df.columns)
    a = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    at = [rel.columns.index(c) for c in cols]
    b = sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
    if len(a) != len(b):
        problems.append(f"{len(a)} rows != {len(b)} rows")
    if a != b:
        sa, sb = set(a), set(b)
        x = [r for r in a if r not in sb][:2]
        y = [r for r in b if r not in sa][:2]
        problems.append(f"values differ in {cols}: spark {x} sql {y}")
    return problems
