"""Holds a query's rows against its SQL in DuckDB."""

from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    return sorted(map(str, df[sorted(df)].astype(object).where(df[sorted(df)].notna(), None).itertuples(index=False, name=None)))


def agree(spark, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = query(spark, str(DATA)).toPandas(), con.execute(sql).df()
    assert sorted(got) == sorted(want)
    assert rows(got) == rows(want)
