"""Compares queries with their SQL the way a strict reader would: columns by name, rows in any order, values rounded."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        files = glob.glob(f"{path}/*.parquet") if os.path.isdir(path) else [path]
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({files})")
    return c


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return None
        if isinstance(v, (float,)) or hasattr(v, "dtype") and v.dtype.kind == "f":
            return round(float(v), 6)
        if hasattr(v, "item"):
            v = v.item()
        return str(v)

    columns = sorted(df.columns)
    rows = [tuple(cell(v) for v in row) for row in df[columns].itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def difference(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(sql_df.columns)}"
    a, b = canonical(spark_df), canonical(sql_df)
    if a == b:
        return ""
    only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"{len(a)} and {len(b)} rows; spark {only_a}; sql {only_b}"
