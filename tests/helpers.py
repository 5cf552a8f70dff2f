"""Comparing a query with SQL that DuckDB runs on the same tables."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).df()


def rows(df) -> list[tuple]:
    df = df[sorted(df.columns)]
    shown = lambda v: "null" if v is None or v is pd.NA or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(shown, r)) for r in df.itertuples(index=False))


def assert_same(spark, sf_dir: str, query, sql: str) -> None:
    ours, theirs = query(spark, sf_dir).toPandas(), duck(sf_dir, sql)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
