"""A Spark result against DuckDB's, order-free."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(table: list[dict], columns: list[str]) -> list[tuple]:
    def norm(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else repr(v + 0.0) if isinstance(v, float) else repr(v)

    return sorted(tuple(norm(r[c]) for c in columns) for r in table)


def assert_same(df, con, sql: str) -> None:
    got = df.toArrow().to_pylist()
    rel = con.sql(sql)
    want = rel.to_arrow_table().to_pylist()
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    assert rows(got, columns) == rows(want, columns)
