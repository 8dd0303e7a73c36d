import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from docloom.sources import sqlite as S


def test_scan_by_ranges_with_filters(spark, tmp_path):
    path = f"{tmp_path}/a b.db"
    con = sqlite3.connect(path)
    con.execute('CREATE TABLE "te ams" (id INTEGER PRIMARY KEY, section TEXT, mark REAL, blob BLOB, "odd ""name" VARCHAR(10), any)')
    rows = [(k * 3, f"s{k % 4}" if k % 5 else None, k / 2 if k % 7 else "n/a", bytes([k % 250]), "é" * (k % 3), k if k % 2 else "x") for k in range(1000)]
    con.executemany('INSERT INTO "te ams" VALUES (?, ?, ?, ?, ?, ?)', rows)
    con.execute("CREATE TABLE plain (k TEXT PRIMARY KEY, v INT) WITHOUT ROWID")
    con.execute("INSERT INTO plain VALUES ('a', 1), ('b', NULL)")
    con.execute("CREATE TABLE empty (k TEXT)")
    con.commit()
    con.close()
    df = S.read(spark, path, "te ams", 5)
    assert [t for _, t in df.dtypes] == ["bigint", "string", "double", "binary", "string", "string"]
    want = [(i, s, None if isinstance(m, str) else m, b, o, str(a)) for i, s, m, b, o, a in rows]
    assert sorted(tuple(r[:3]) + (bytes(r[3]), *r[4:]) for r in df.collect()) == sorted(want, key=lambda r: r[0]) and df.rdd.getNumPartitions() == 5
    some = df.where((F.col("id") >= 300) & F.col("section").isin("s1", "s2") & F.col("mark").isNotNull() & (F.length("any") > 1))
    assert sorted(r.id for r in some.collect()) == [r[0] for r in want if r[0] >= 300 and r[1] in ("s1", "s2") and r[2] is not None and len(r[5]) > 1]
    assert df.where("section IS NULL AND mark < 100").count() == sum(r[1] is None and r[2] is not None and r[2] < 100 for r in want)
    assert {tuple(r) for r in S.read(spark, path, "plain").collect()} == {("a", 1), ("b", None)} and S.read(spark, path, "empty").count() == 0
    with pytest.raises(Exception, match="no table"):
        S.read(spark, path, "none").count()


def test_written_tables(spark, tmp_path):
    path = f"{tmp_path}/t.db"
    df = spark.range(0, 500, numPartitions=4).select("id", F.concat(F.lit("n"), "id").alias("name"), (F.col("id") / 3).alias("mark"), F.when(F.col("id") % 2 == 0, F.col("id").cast("int")).alias("even"))
    S.write(df, path, "t")
    same = lambda got, df: sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    assert same(S.read(spark, path, "t").where("even IS NOT NULL"), df.where("even IS NOT NULL")) and S.read(spark, path, "t").count() == 500
    S.write(df.limit(7), path, "t", "append")
    assert S.read(spark, path, "t").count() == 507
    S.write(df.limit(7), path, "t")
    S.write(df.limit(0), path, "u")
    assert S.read(spark, path, "t").count() == 7 and S.read(spark, path, "u").count() == 0
    assert os.listdir(tmp_path) == ["t.db"]
