"""Holds a query's rows against its SQL in DuckDB."""

import os

import duckdb
import pandas as pd

SMALL = "/root/testdata/sf0.001"


def by_sql(sql: str, sf_dir: str = SMALL) -> pd.DataFrame:
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}'")
    return c.sql(sql).df()


def rows(df: pd.DataFrame) -> list[tuple]:
    """Sorted rows as text, columns in the order of their names; numbers as floats of nine digits."""

    def cell(x):
        if x is None or x is pd.NaT or isinstance(x, float) and x != x:
            return "null"
        if isinstance(x, pd.Timestamp):
            return str(x.tz_localize(None) if x.tzinfo else x)
        if isinstance(x, bool) or type(x).__name__ == "bool":
            return str(bool(x))
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.astype(object).itertuples(index=False, name=None))


def same(spark_df, sql: str, sf_dir: str = SMALL) -> None:
    got, want = spark_df.toPandas(), by_sql(sql, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    # whole numbers with nulls are floats in pandas
    for c in got.columns:
        if want[c].dtype.kind == "f" or got[c].dtype.kind == "f":
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert rows(got) == rows(want)
