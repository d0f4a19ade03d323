"""Comparison of a query's rows with those of its SQL in DuckDB."""

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        f = f"{sf_dir}/{t}.parquet"
        if glob.glob(f):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{f + '/*.parquet' if os.path.isdir(f) else f}'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (list, np.ndarray)):
        return str([plain(x) for x in v])
    if isinstance(v, (int, float, np.integer, np.floating)):
        return None if math.isnan(v) else round(float(v), 6)
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False, name=None)), key=lambda r: tuple(map(str, r)))
