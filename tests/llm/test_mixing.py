from collections import defaultdict

import pytest

from docloom.llm import mixing

from .oracle import assert_same


def test_query_equals_sql(spark, sf):
    assert_same(spark, sf, mixing.op1, mixing.ORACLE)


def test_marginals_meet_their_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.rake(docs, cycles=60).collect()
    for dim in ("source", "lang", "topic"):
        raw, got = defaultdict(float), defaultdict(float)
        for r in rows:
            raw[r[dim]] += r.tokens
            got[r[dim]] += r.tokens * r.weight
        total = sum(v ** mixing.TEMPER[dim] for v in raw.values())
        for k, v in raw.items():
            assert got[k] / sum(got.values()) == pytest.approx(v ** mixing.TEMPER[dim] / total, rel=2e-3), (dim, k)
    assert max(r.keep_prob for r in rows) == pytest.approx(1)


def test_given_targets_and_a_sample(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {"lang": {"en": 0.25, "de": 0.25, "fr": 0.5}}
    rows = mixing.rake(docs, want, cycles=60).collect()
    share = defaultdict(float)
    for r in rows:
        share[r.lang] += r.tokens * r.weight
    assert share["es"] == 0 and share["fr"] / sum(share.values()) == pytest.approx(0.5, rel=1e-3)
    kept = mixing.sample(docs, want)
    assert kept.columns == docs.columns and kept.where("lang = 'es'").count() == 0


def test_one_tiny_source_leaves_the_corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tiny = spark.createDataFrame([(10**9, "a row of a source by itself alone", "en", "tiny", 33)], docs.schema)
    rows = mixing.rake(docs.union(tiny)).collect()
    assert sum(r.keep_prob for r in rows) >= mixing.MIN_KEPT * len(rows)
    rate = {round(r.keep_prob / r.weight, 6) for r in rows if r.keep_prob < 1}  # below the cap the mixture's ratios hold
    assert max(rate) - min(rate) < 2e-6 and all(r.keep_prob == 1 for r in rows if r.source == "tiny")
    assert mixing.sample(docs.union(tiny)).count() > 0.4 * len(rows)
    # the least scale that does: no more than a few digits above it
    assert sum(r.keep_prob for r in rows) < (mixing.MIN_KEPT + 0.01) * len(rows)


def test_odd_rows_and_no_rows(spark, odd_docs, no_docs):
    rows = mixing.rake(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.keep_prob <= 1 and r.weight >= 0 for r in rows)
    assert {r.tokens for r in rows if not r.text} == {0}
    assert mixing.rake(no_docs).count() == 0 and mixing.sample(no_docs).columns == no_docs.columns


def test_plan_is_native(spark, sf):
    plan = mixing.op1(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_long_tables_of_sources_are_joined_in_parts(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: (round(r.weight, 9), round(r.keep_prob, 9)) for r in mixing.rake(docs).collect()}
    monkeypatch.setattr(mixing, "MAX_BROADCAST_ROWS", 0)
    monkeypatch.setattr(mixing, "SPLIT_DOCS", 3)
    assert {r.doc_id: (round(r.weight, 9), round(r.keep_prob, 9)) for r in mixing.rake(docs).collect()} == want


def test_too_many_cells_and_few_cycles(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    few = {r.doc_id: r.weight for r in mixing.rake(docs, cycles=1).collect()}  # goes on until the marginals are met
    for r in mixing.rake(docs, cycles=40).collect():
        assert few[r.doc_id] == pytest.approx(r.weight, rel=1e-3)
    monkeypatch.setattr(mixing, "MAX_CELLS", 2)
    with pytest.raises(ValueError):
        mixing.rake(docs)
