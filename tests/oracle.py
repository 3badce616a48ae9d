"""Compares a Spark result with DuckDB's on the same tables."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def by_sql(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.execute(sql).fetchdf()


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame({c: df[c].map(lambda v: None if v is None or (not isinstance(v, (list, np.ndarray)) and pd.isna(v)) else round(float(v), 6) if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, bool) else str(v)) for c in sorted(df.columns)})
    return out.astype(object).where(out.notna(), None)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty if both hold the same rows."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    rows = [sorted(map(repr, _plain(x).itertuples(index=False, name=None))) for x in (got, want)]
    odd = [(a, b) for a, b in zip(*rows) if a != b]
    return f"{len(odd)} rows differ, as {odd[:2]}" if odd else ""
