"""Run registered queries in Spark and their SQL in DuckDB, and compare the rows exactly."""

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return f"f{value:.9g}" if value != 0 else "f0"
    return f"{type(value).__name__[0]}{value}"


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_key(row[i]) for i in order) for row in rows)


def differences(name: str, query, sql: str, spark, sf_dir: str, con) -> str | None:
    """None when both give the same columns and rows, else what differs first."""
    df = query(spark, sf_dir)
    mine = [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    theirs_columns = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(df.columns) != sorted(theirs_columns):
        return f"{name}: columns {sorted(df.columns)} against {sorted(theirs_columns)}"
    if len(mine) != len(theirs):
        return f"{name}: {len(mine)} rows against {len(theirs)}"
    for a, b in zip(_rows(df.columns, mine), _rows(theirs_columns, theirs)):
        if a != b:
            return f"{name}: {a} against {b}"
    return None
