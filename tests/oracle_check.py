"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from decimal import Decimal

import duckdb
import pandas as pd

from perkflow.sources.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normalize(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    cols = []
    for c in df.columns:
        s = df[c]
        if s.dtype == object and any(isinstance(v, Decimal) for v in s):  # DuckDB's frames hold decimals as floats
            s = s.astype(float)
        if pd.api.types.is_float_dtype(s):
            s = s.round(6)
        if pd.api.types.is_datetime64_any_dtype(s):
            s = s.astype("datetime64[us]")
        cols.append(s.astype(str))
    return sorted(map(tuple, zip(*cols))) if cols else []


def compare(spark_df: pd.DataFrame, oracle_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(oracle_df.columns):
        return f"columns differ: {sorted(spark_df.columns)} vs {sorted(oracle_df.columns)}"
    if len(spark_df) != len(oracle_df):
        return f"row counts differ: {len(spark_df)} vs {len(oracle_df)}"
    a, b = normalize(spark_df), normalize(oracle_df)
    if a != b:
        only_a = sorted(set(a) - set(b))[:3]
        only_b = sorted(set(b) - set(a))[:3]
        return f"values differ: spark-only {only_a} oracle-only {only_b}"
    return None
