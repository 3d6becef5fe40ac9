"""Rows of a query's SQL by DuckDB, over the tables of a folder or given ones."""

import os

import duckdb


def rows(sql, sf_dir="/root/testdata/sf0.001", **tables):
    db = duckdb.connect()
    for f in os.listdir(sf_dir):
        db.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    for name, frame in tables.items():
        db.execute(f"drop view if exists {name}")
        db.register(name, frame)
    cursor = db.execute(sql)
    names = [c[0] for c in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=str)


def frame_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=str)
