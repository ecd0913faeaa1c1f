"""Compares a query's rows with its SQL in DuckDB, regardless of order."""

from __future__ import annotations

import os
from collections import Counter
from decimal import Decimal

import duckdb
import numpy as np
import pandas as pd


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and np.isnan(x):
        return None
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(y) for y in x)
    if isinstance(x, (int, float, np.integer, np.floating, Decimal)):
        return round(float(x), 6)
    return str(pd.Timestamp(x)) if hasattr(x, "isoformat") else str(x)


def rows(frame: pd.DataFrame) -> Counter:
    return Counter(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


def duck(folder: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return con.execute(sql).df()
