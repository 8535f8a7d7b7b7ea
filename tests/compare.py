"""Spark results against DuckDB's on the same tables."""

import math
import os

import duckdb
import pandas as pd

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir=SMALL):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


def kind(name):
    return {"string": "varchar", "int": "integer", "timestamp_ntz": "timestamp"}.get(name.lower(), name.lower())


def check_against_duckdb(spark, query, sql, sf_dir=SMALL):
    got = query(spark, sf_dir)
    want = duck(sf_dir).sql(sql)
    assert sorted((n, kind(k)) for n, k in got.dtypes) == sorted((n, kind(str(k))) for n, k in zip(want.columns, want.types))
    a, b = rows(got.toPandas()), rows(want.df())
    assert a == b
    assert a
