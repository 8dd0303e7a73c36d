"""Every query of the package against its SQL."""

import os

import duckdb
import pytest

from docloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents labels benchmark".split()


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    got = registry.QUERIES[name](spark, sf)
    res = con.execute(registry.ORACLES[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == sorted(got.columns)
    mine = sorted(repr(tuple(plain(r[c]) for c in names)) for r in got.collect())
    assert mine == sorted(repr(tuple(map(plain, r))) for r in res.fetchall())


def test_rest_runs(spark, sf):
    for name in set(registry.QUERIES) - set(registry.ORACLES):
        assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry_has_every_query_without_the_llm_folder(spark, sf):
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["tokens_a", "tokens_b", "jaccard"]
    root = os.path.dirname(os.path.abspath(e.__file__))
    for folder, _, files in os.walk(f"{root}/docloom"):
        if "llm" not in folder:
            assert not any("docloom.llm" in open(f"{folder}/{f}").read() for f in files if f.endswith(".py"))
