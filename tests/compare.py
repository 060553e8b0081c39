"""Rows of two engines, made comparable."""

import os

import numpy as np
import pandas as pd


def cell(x):
    if isinstance(x, (list, np.ndarray)):
        return "[" + ",".join(map(cell, x)) + "]"
    if isinstance(x, dict):
        return str({k: cell(v) for k, v in x.items()})
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
        return "NULL"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, np.integer)):
        return str(int(x))
    if isinstance(x, (float, np.floating)):
        return str(int(x)) if float(x).is_integer() else repr(round(float(x), 9))
    return str(x)


def rows(frame):
    return sorted("|".join(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{t}'")
    return con
