"""Comparison of a query with its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}'")
    return c


def _rows(df: pd.DataFrame) -> list[tuple]:
    def value(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "~"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return f"{float(v):.6g}"
        return str(v)

    cols = sorted(df.columns)
    return sorted(tuple(map(value, r)) for r in df[cols].itertuples(index=False))


def assert_same(found: pd.DataFrame, wanted: pd.DataFrame) -> None:
    assert sorted(found.columns) == sorted(wanted.columns)
    a, b = _rows(found), _rows(wanted)
    assert len(a) == len(b)
    assert [x for x, y in zip(a, b, strict=True) if x != y][:3] == [y for x, y in zip(a, b, strict=True) if x != y][:3]
