"""Runs a query and its SQL on the same tables and compares the rows."""

import os

import duckdb
import pandas as pd

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def text(value) -> str:
    if value is None or value is pd.NaT or value is pd.NA:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if value != value:
            return "NULL"
        return str(int(value)) if value == int(value) and abs(value) < 2**53 else f"{value:.9g}"
    return str(value)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(text(v) for v in r) for r in df.itertuples(index=False))
