"""Rows of a query against rows of its SQL."""

from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd


def views(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def rows_of(df: pd.DataFrame) -> Counter:
    def plain(x):
        if x is None or x is pd.NA or (isinstance(x, (float, np.floating)) and np.isnan(x)):
            return None
        if isinstance(x, (bool, np.bool_)):
            return bool(x)
        return float(x) if isinstance(x, (float, np.floating)) else int(x) if isinstance(x, (int, np.integer)) else x

    df = df[sorted(df.columns)]
    return Counter(tuple(map(plain, r)) for r in df.itertuples(index=False))
