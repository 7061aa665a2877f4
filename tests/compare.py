"""Runs registered queries in Spark and DuckDB over one folder of driver tables."""

import glob
import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(folder=DATA):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(row[i]) for i in order) for row in found), key=repr)


def both(spark, name, queries, oracle, folder=DATA):
    df = queries[name](spark, folder)
    duck = connect(folder).sql(oracle[name])
    return rows(df.columns, [tuple(r) for r in df.collect()]), rows(duck.columns, duck.fetchall())
