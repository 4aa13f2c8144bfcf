"""Compares a query with its DuckDB SQL over the same tables."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return None if pd.isna(value) else value
    if value is pd.NaT or value is pd.NA:
        return None
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    if hasattr(value, "item"):
        return value.item()
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return tuple(map(_plain, value))
    return value


def _rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(([_plain(v) for v in row] for row in frame.astype(object).itertuples(index=False)), key=repr)


def compare(spark, query, sql: str, sf_dir: str = DATA) -> str:
    """Empty if both agree, else what differs."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    theirs = con.execute(sql).df()
    mine = query(spark, sf_dir).toPandas()
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(set(mine.columns) ^ set(theirs.columns))}"
    a, b = _rows(mine), _rows(theirs)
    if len(a) != len(b):
        return f"{len(a)} rows, not {len(b)}"
    off = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    if not off:
        return ""
    x, y = off[0]
    names = sorted(mine.columns)
    return f"{len(off)} of {len(a)} rows differ, first in {[(n, p, q) for n, p, q in zip(names, x, y, strict=True) if p != q][:5]}"
