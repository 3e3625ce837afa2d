"""Runs a registered query and its SQL on the same tables and compares them."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'; set threads = 2")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(value):
    """A value as both engines can say it."""
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return float(f"{value:.10g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat() if hasattr(value, "tzinfo") else value.isoformat()
    return value


def kind(name: str) -> str:
    """Of a type of either engine."""
    name = name.lower()
    for of, names in {"whole": ("tinyint", "smallint", "int", "bigint", "long", "hugeint"), "real": ("float", "double", "decimal"), "text": ("varchar", "string"), "time": ("timestamp", "date")}.items():
        if name.startswith(names):
            return of
    return name


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    rel = con.sql(sql)
    columns = sorted(df.columns)
    if columns != sorted(rel.columns):
        return [f"columns {columns} and {sorted(rel.columns)}"]
    mine = {n: kind(t) for n, t in df.dtypes}
    theirs = {n: kind(str(t)) for n, t in zip(rel.columns, rel.types, strict=True)}
    out = [f"{c} is {mine[c]} and {theirs[c]}" for c in columns if mine[c] != theirs[c]]
    order = lambda row: [(x is not None, str(type(x)), x) for x in row]
    a = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=order)
    at = [rel.columns.index(c) for c in columns]
    b = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=order)
    if len(a) != len(b):
        out.append(f"{len(a)} and {len(b)} rows")
    out += [f"{x} and {y}" for x, y in zip(a, b, strict=False) if x != y][:3]
    return out
