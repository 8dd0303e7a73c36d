import random
import re

import pytest
import xxhash
from docloom.llm import simhash as H


def slow_fingerprint(t):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def slow_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    low = {}
    for k, (d, _) in enumerate(fps):
        low[find(k)] = min(low.get(find(k), d), d)
    return {d: low[find(k)] for k, (d, _) in enumerate(fps)}


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fps = [(r.doc_id, slow_fingerprint(r.text)) for r in docs]
    want = slow_components(fps)
    got = H.op7(spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{f:016x}", want[d]) for d, f in fps}


def test_links_and_components_against_all_pairs(spark):
    draw = random.Random(4)
    base = [draw.getrandbits(64) for _ in range(40)] + [0, 2**64 - 1, 2**63]
    fps = set(base)
    for _ in range(300):
        f = draw.choice(sorted(fps))
        for b in draw.sample(range(64), draw.randrange(1, 6)):
            f ^= 1 << b
        fps.add(f)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert {tuple(r) for r in H.links(df).collect()} == want
    prints = spark.createDataFrame([(k, f) for k, f in enumerate(signed)], "doc_id long, fp long")
    want = slow_components([(k, f & (2**64 - 1)) for k, f in enumerate(signed)])
    assert {signed.index(r.fp): r.component_id for r in H.classes(prints).collect()} == want


def test_long_chain_and_star(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)]
    roots = {r.node: r.root for r in H.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(roots[k] == 0 for k in range(1, 201)) and all(roots[k] == 1000 for k in range(1001, 1300))


def test_unsettled_components_are_refused(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(50)], "a long, b long")
    with pytest.raises(RuntimeError):
        H.components(edges, max_rounds=1)


def test_odd_rows_and_no_rows(spark, odd_docs, no_docs):
    found = H.near_duplicates(odd_docs).collect()
    assert len(found) == odd_docs.count()
    blank = [r for r in found if r.fp == 0]
    assert len(blank) == 4 and {r.component_id for r in blank} == {3}
    kept = H.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 1, 3, 6, 7, 8]
    assert H.near_duplicates(no_docs).count() == 0 and H.keep_one(no_docs).count() == 0


def test_probes_are_not_broadcast(spark):
    fps = spark.createDataFrame([(0,), (1,), (0x7000,)], "fp long")
    found = H.links(fps)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(0, 1), (0, 0x7000)]
