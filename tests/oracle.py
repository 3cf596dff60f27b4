"""Run a query in Spark and its oracle in DuckDB, and compare rows without regard to order."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return tuple(map(normal, v)) if isinstance(v, (list, tuple)) else v


def ordered(rows, names):
    at = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(normal(r[i]) for i in at) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


def check(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert ordered(map(tuple, df.collect()), df.columns) == ordered(found.fetchall(), names)
