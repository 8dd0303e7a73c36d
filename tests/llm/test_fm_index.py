import hashlib
import random
import re

import numpy as np
import pytest

from docloom.llm import fm_index as M

from .oracle import assert_same

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).update({str(i)} if i is not None else ())
    out = []
    for d, t in docs:
        w, ids = words(t), set()
        hit = [False] * len(w)
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in wins:
                    hit[k : k + n] = [True] * n
                    ids |= wins[g]
        out.append((d, len(w), sum(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), any(hit)))
    return sorted(out, key=repr)


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = brute(docs, items)
    assert any(w[5] for w in want)
    assert sorted((tuple(r) for r in M.op4(spark, sf).collect()), key=repr) == want


@pytest.mark.parametrize("shard,block", [(50, 10**6), (10**6, 5)])
def test_many_shards_and_many_passes(spark, shard, block):
    draw = random.Random(shard)
    text = lambda n: " ".join(draw.choice("a b c de f-g H 9 é".split()) for _ in range(n))
    docs = [(k, text(draw.randrange(40))) for k in range(60)]
    items = [(k, text(n)) for k, n in enumerate([1, 2, 3, 12, 11, 0, 4])] + [(8, docs[4][1]), (None, docs[5][1]), (9, None), (8, docs[4][1])]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = M.find(df, bench, window=4, shard_words=shard, pass_windows=block).collect()
    got = [(r.doc_id, r.n_words, sum(s.stop - s.start for s in r.spans), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(r.spans)) for r in found]
    assert sorted(got, key=repr) == brute(docs, items, 4)
    for r in found:
        assert all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_index_against_plain_search():
    draw = np.random.default_rng(2)
    for n, sigma in ((1, 1), (7, 2), (400, 3), (3000, 50)):
        seq = draw.integers(0, sigma, n)
        sa = M.suffix_array(seq.copy())
        assert sa.tolist() == sorted(range(n), key=lambda i: seq[i:].tolist())
    index = M.FMIndex(np.concatenate([seq, [0]]) + np.r_[np.ones(n, np.int64), 0])  # a sentinel ends the sequence
    seq = np.r_[seq + 1, 0]
    for _ in range(200):
        k, m = int(draw.integers(0, n - 3)), int(draw.integers(1, 4))
        low, high = index.search(seq[None, k : k + m], np.array([m]))
        at = np.sort(index.locate(np.arange(low[0], high[0])))
        assert at.tolist() == [i for i in range(n) if seq[i : i + m].tolist() == seq[k : k + m].tolist()]


def test_cutting(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Before, {item.upper()}! After é.", 5), (2, "clean text", 3), (3, None, None), (4, item, 1)]
    out = M.decontaminate(spark.createDataFrame(docs, "doc_id long, text string, n_chars long"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r.doc_id: r.text for r in out.collect()} == {1: "Before, ! After é.", 2: "clean text", 3: None, 4: ""}


@pytest.mark.parametrize("block", [10**6, 5])
def test_passes_and_cutting_share_a_worker(spark, block):
    items = [(k, f"stop{k} here{k} now{k} and{k} then{k}") for k in range(6)]
    docs = [(k, f"Kept {k}, {t.upper()}! Rest.", 1) for k, t in items] + [(9, f"{items[0][1]} middle {items[5][1]}", 2), (10, None, 3), (11, "clean", 4)]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    out = M.decontaminate(df, bench, window=4, shard_words=8, pass_windows=block)
    assert {(r.doc_id, r.text, r.n_chars) for r in out.collect()} == {*((k, f"Kept {k}, ! Rest.", 1) for k in range(6)), (9, " middle ", 2), (10, None, 3), (11, "clean", 4)}
    # each MapInArrow of a stage has a worker of its own beside every task, and workers live on
    for frame in (out, M.find(df, bench, 4, 8, block)):
        assert frame._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "quick BROWN fox"), (2, "..."), (3, None)], "item_id long, text string")
    out = M.find(odd_docs, bench).collect()
    assert len(out) == odd_docs.count() and sum(bool(r.spans) for r in out) == 3
    assert M.find(no_docs, bench).count() == 0
    assert not any(r.spans for r in M.find(odd_docs, bench.limit(0)).collect())


def test_query_equals_sql(spark, sf):
    assert_same(spark, sf, M.op4, M.ORACLE)
