"""Comparison of a query with its SQL, as sorted rows with rounded doubles."""

import os

import duckdb


def plain(x):
    return round(float(x), 6) if isinstance(x, float) else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same(spark, query, sql, folder):
    got = query(spark, folder)
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, res.fetchall())
