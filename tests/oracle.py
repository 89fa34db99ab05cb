"""Comparison of a query's rows with those of its SQL."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    def plain(x):
        if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
            return ""
        if isinstance(x, (bool, str)):
            return str(x)
        try:
            return f"{float(x):.9g}"
        except (TypeError, ValueError):
            return str(x)

    return sorted(tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
