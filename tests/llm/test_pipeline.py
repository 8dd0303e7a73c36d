from collections import Counter

import corpus_pipeline as P
from docloom.llm import fm_index, language_id, mixing

from .test_fm_index import brute
from .test_near_copies import jaccard_groups


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3).cache()
    steps = [docs]
    for name, stage in P.STAGES:
        out = stage(spark, steps[-1], sf)
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns
        steps.append(out.cache())
    rows = [{r.doc_id: r for r in s.collect()} for s in steps]
    start, langs, once, clean, mixed, sharded = rows
    assert [len(r) for r in rows] == [s.count() for s in steps]
    # language ID: exactly the documents that the model is sure of
    model = language_id.train(language_id.learnt_rows(docs))
    sure = {d for d, r in start.items() if (p := model.predict(r.text))[0] != "und" and p[1] >= P.MIN_CONFIDENCE}
    assert set(langs) == sure and len(sure) > 0.9 * len(start)
    # near copies: the smallest id of each group of five-word Jaccard 0.8
    assert set(once) == set(jaccard_groups({d: r.text for d, r in langs.items()}).values())
    # benchmark passages: no hit is left of those that were there, clean texts are untouched
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {d for d, *_, c in brute([(d, r.text) for d, r in once.items()], items) if c}
    assert hit and set(clean) == set(once)
    assert all((clean[d].text != once[d].text) == (d in hit) for d in once)
    assert all(r.n_chars == len(r.text) for d, r in clean.items() if d in hit)
    # mixture: kept by a draw against the calibrated probability
    raked = {r.doc_id: r for r in mixing.rake(steps[3]).withColumn("u", mixing.draw(mixing.F.col("doc_id"))).collect()}
    assert set(mixed) == {d for d, r in raked.items() if r.u < r.keep_prob}
    # shards: every document once, slots without gaps
    assert set(sharded) == set(mixed) and all(sharded[d].text == mixed[d].text for d in mixed)
    by = {}
    for r in sharded.values():
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_run_and_odd_rows(spark, sf, odd_docs):
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} <= set(P.run(spark, sf).columns)
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    rows = lambda df: Counter(tuple(r[c] for c in docs.columns) for r in df.collect())
    given, by = rows(docs), dict(P.STAGES)
    # rows without letters go, all others that stay are as they were but for a language that was missing
    known = by["language_id"](spark, docs, sf)
    assert all(any(c.isalpha() for c in r[1]) for r in rows(known)) and rows(known) <= Counter({(*r[:2], r[2] or x, *r[3:]): n for r, n in given.items() for x in ("en", "de", "fr", "es")})
    # one of the three rows of a text, one of the four without words, with the smallest id
    once = by["near_dedup"](spark, docs, sf)
    assert sorted((r[0], (r[1] or "")[:11]) for r in rows(once) if r[0] is not None) == [(1, "Another tex"), (1, "The quick b"), (3, ""), (6, "12345 !!! 6"), (7, "word0 item0"), (8, "Über die St")]
    assert sorted(r[1] for r in rows(once) if r[0] is None) == ["An id is missing here"] and sum(rows(once).values()) == 7 and rows(once) <= given
    # nothing here is in the benchmark: all rows stay, null texts with their n_chars
    clean = by["decontamination"](spark, docs, sf)
    assert rows(clean) == Counter((*r[:4], r[4] if r[1] is None else len(r[1])) for r in given.elements())
    mixed = by["mixing"](spark, docs, sf)
    assert rows(mixed) <= given
    shards = by["sharding"](spark, docs, sf)
    assert rows(shards) == given and {r.shard for r in shards.collect() if r.doc_id is None} and len({r.shard for r in shards.collect() if r.doc_id == 1}) == 1
    empty = odd_docs.limit(0).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in P.STAGES:
        assert stage(spark, empty, sf).count() == 0
    assert fm_index.WINDOW == 10
