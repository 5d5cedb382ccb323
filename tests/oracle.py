"""Hold a query's rows against DuckDB's for the same tables."""

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{Path(sf_dir) / t}.parquet')")
    return con


def plain(v):
    """One form for each value: no NaN or NA, whole floats as integers."""
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating)):
        v = round(float(v), 6)
        return int(v) if v.is_integer() else v
    return int(v) if isinstance(v, np.integer) else v


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    rows = [tuple(map(plain, r)) for r in frame.astype(object).itertuples(index=False)]
    return list(frame.columns), sorted(rows, key=repr)


def compare(got, want):
    a, b = canonical(got), canonical(want)
    assert a[0] == b[0], (a[0], b[0])
    assert len(a[1]) == len(b[1]), (len(a[1]), len(b[1]))
    for x, y in zip(a[1], b[1], strict=True):
        assert x == y, (x, y)
