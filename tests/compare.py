"""Runs registered queries beside their SQL and compares all rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def spark_rows(df) -> tuple[list[str], list[str]]:
    names = sorted(df.columns)
    types = dict(df.dtypes)
    rows = sorted("|".join(_cell(r[n]) for n in names) for r in df.select(*[f"`{n}`" for n in names]).collect())
    return [f"{n}:{types[n]}" for n in names], rows


def duck_rows(con, sql: str) -> tuple[list[str], list[str]]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]).lower() for d in cur.description}
    data = cur.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = sorted("|".join(_cell(r[i]) for i in order) for r in data)
    return [f"{names[i]}:{types[names[i]]}" for i in order], rows


SAME_TYPE = {"varchar": "string", "integer": "int", "bigint": "bigint", "double": "double", "boolean": "boolean"}


def differences(df, con, sql: str) -> list[str]:
    """What differs between a Spark result and its SQL; empty when nothing does."""
    spark_schema, got = spark_rows(df)
    duck_schema, want = duck_rows(con, sql)
    renamed = [f"{c.split(':')[0]}:{SAME_TYPE.get(c.split(':')[1], c.split(':')[1])}" for c in duck_schema]
    out = []
    if spark_schema != renamed:
        out.append(f"schema {[p for p in zip(spark_schema, renamed) if p[0] != p[1]] or (spark_schema, renamed)}")
    if len(got) != len(want):
        out.append(f"{len(got)} rows, expected {len(want)}")
    if got != want:
        a, b = set(got), set(want)
        out.append(f"only here {sorted(a - b)[:3]}; only expected {sorted(b - a)[:3]}")
    return out
