"""Compares a query's rows with what DuckDB makes of its SQL."""

import os

import duckdb


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    return str(value)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = bag(df.columns, [tuple(r) for r in df.collect()])
    db = duckdb.connect()
    db.sql("SET timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        db.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    want = db.sql(sql)
    assert got == bag(want.columns, want.fetchall())
