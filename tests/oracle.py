"""Compares a DataFrame with SQL that DuckDB runs over the same tables."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def by_sql(sql, data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c.execute(sql).df()


def shown(df):
    cols = sorted(df.columns)
    out = df[cols].copy()
    for c in cols:
        real = out[c].dtype.kind == "f"
        out[c] = out[c].map(lambda v: "" if v is None or not hasattr(v, "__len__") and pd.isna(v) else f"{v:.6g}" if real else str(v))
    return out.sort_values(cols).reset_index(drop=True)


def same(df, sql, data):
    a, b = shown(df.toPandas()), shown(by_sql(sql, data))
    assert list(a.columns) == list(b.columns)
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
