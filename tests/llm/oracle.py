import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def assert_same(spark, sf, query, sql):
    got = query(spark, sf)
    res = views(sf).execute(sql)
    names = [c[0] for c in res.description]
    assert sorted(got.columns) == sorted(names)
    mine = sorted(repr(plain(tuple(r[c] for c in names))) for r in got.collect())
    assert mine == sorted(repr(plain(r)) for r in res.fetchall())
