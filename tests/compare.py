"""Holds a query's rows against its SQL in DuckDB."""

import glob
import os

import duckdb


def tables(folder):
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return db


def norm(value):
    return round(value, 6) if isinstance(value, float) else tuple(value) if isinstance(value, list) else value


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(norm, r)) for r in frame.select(columns).collect()), key=repr)


def rows_of_sql(db, sql):
    found = db.execute(sql)
    columns = [c[0] for c in found.description]
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(columns), sorted((tuple(norm(r[i]) for i in order) for r in found.fetchall()), key=repr)
