"""Compares a query's rows with those of its SQL in DuckDB, whatever their order."""

import os

import duckdb
import pandas as pd


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def rows_of(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if str(frame[c].dtype).startswith("datetime"):
            frame[c] = pd.to_datetime(frame[c]).astype("datetime64[us]").astype(str)
        frame[c] = [None if v is None or v is pd.NA or v != v else v for v in frame[c].astype(object)]
    return sorted((tuple(x) for x in frame.itertuples(index=False)), key=repr)


def assert_parity(df, con, sql):
    got, want = df.toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows_of(got), rows_of(want)
    assert len(a) == len(b)
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y and repr(x) != repr(y)]
    assert not wrong, wrong[:3]
