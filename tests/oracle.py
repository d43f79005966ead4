"""Comparison of a query with its SQL on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    """Rows by the columns that aren't floats, then by those that are; -0.0 is 0.0."""
    df = df[sorted(df.columns)].copy()
    floats = [c for c in df.columns if pd.api.types.is_float_dtype(df[c]) and df[c].dropna().mod(1).ne(0).any()]
    for c in df.columns:
        df[c] = df[c] + 0.0 if c in floats else df[c].map(lambda x: "" if x is None or x is pd.NA or x != x else str(int(x)) if isinstance(x, float) and x == int(x) else str(x))
    return df.sort_values([c for c in df.columns if c not in floats] + floats, kind="stable").reset_index(drop=True)


def compare(spark, query, sql: str, tolerance: float = 2e-5) -> None:
    """Equal rows, floats within a rounding's last place or ``tolerance`` of their size."""
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got, expect = query(spark, FOLDER).toPandas(), db.execute(sql).df()
    assert sorted(got.columns) == sorted(expect.columns) and len(got) == len(expect)
    got, expect = ordered(got), ordered(expect)
    for c in got.columns:
        if pd.api.types.is_float_dtype(got[c]) and pd.api.types.is_float_dtype(expect[c]):
            np.testing.assert_allclose(got[c].to_numpy(), expect[c].to_numpy(), rtol=tolerance, atol=tolerance, equal_nan=True, err_msg=c)
        else:
            assert got[c].tolist() == expect[c].tolist(), c
