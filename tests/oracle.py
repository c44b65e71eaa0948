"""Rows of a Spark query and of its SQL in DuckDB, in a comparable form."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        source = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{source}'")
    return c


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def both(spark, sf_dir, run, sql):
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    cursor = connect(sf_dir).execute(sql)
    found = [d[0] for d in cursor.description]
    assert sorted(found) == names
    at = [found.index(n) for n in names]
    ours = sorted(tuple(cell(r[n]) for n in names) for r in df.collect())
    return ours, sorted(tuple(cell(r[i]) for i in at) for r in cursor.fetchall())
