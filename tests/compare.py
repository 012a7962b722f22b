"""Row-by-row comparison of a Spark result with DuckDB's."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
        return "~"
    if isinstance(x, (bool, str)) or type(x).__name__ == "bool_":
        return str(x)
    return repr(float(x)) if isinstance(x, (int, float)) or hasattr(x, "dtype") and getattr(x, "ndim", 1) == 0 else str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(x) for x in r) for r in frame.itertuples(index=False))


def oracle(sql, sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c.execute(sql).fetchdf()
