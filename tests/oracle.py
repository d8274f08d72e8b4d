"""Runs a query in Spark and its SQL in DuckDB over the same tables and compares the rows, whatever their order."""

import math
import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT:
            return "null"
        v = v.item() if hasattr(v, "item") else v
        if isinstance(v, float):
            if math.isnan(v):
                return "null"
            return str(int(v)) if v == int(v) else str(round(v, 6))
        return str(int(v)) if isinstance(v, bool | int) else str(v)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def database(sf: str = DATA):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con
