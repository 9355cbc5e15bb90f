"""Side-by-side comparison of a query and its checking SQL."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v: object) -> str:
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, (int, float)) or type(v).__name__ in ("Decimal", "int32", "int64", "float32", "float64"):
        return f"{float(v):.7f}".replace("-0.0000000", "0.0000000")
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    df = df.reindex(sorted(df.columns), axis=1)
    return sorted(tuple(map(_cell, r)) for r in df.itertuples(index=False))
