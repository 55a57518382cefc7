"""Spark results against SQL run by DuckDB on the same files."""

import math
import os

import duckdb


def norm(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return round(float(value), 9)
    return str(value)


def compare(spark, folder, query, sql):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{folder}/{name}')")
    ours = query(spark, folder)
    columns = sorted(ours.columns)
    result = con.execute(sql)
    theirs = [d[0] for d in result.description]
    assert sorted(theirs) == columns
    at = [theirs.index(c) for c in columns]
    expected = sorted((tuple(norm(r[i]) for i in at) for r in result.fetchall()), key=str)
    assert sorted((tuple(norm(r[c]) for c in columns) for r in ours.collect()), key=str) == expected
