import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import suffix_dedup as S


def brute(rows):
    """(n_bytes, n_removed, n_spans, kept hash) by (doc, text), with every window of LENGTH bytes in a set."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        gone = bytearray(len(t))
        for i in range(len(t) - S.LENGTH + 1):
            w = t[i : i + S.LENGTH]
            if w in seen:
                gone[i : i + S.LENGTH] = b"\1" * S.LENGTH
            seen.add(w)
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out[d] = (len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    return out


def got(df, **kw):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(df, **kw).collect()}


def random_docs(seed):
    draw = random.Random(seed)
    part = lambda n: "".join(draw.choice("abcdé \n") for _ in range(n))
    shared = [part(n) for n in (99, 100, 101, 163, 400, 900)]
    docs = []
    for k in range(60):
        t = part(draw.randrange(0, 300))
        for _ in range(draw.randrange(0, 4)):
            s = draw.choice(shared)
            if draw.random() < 0.3:
                at = draw.randrange(len(s))
                s = s[:at] + "X" + s[at + 1 :]
            t += s[draw.randrange(0, 20) :] + part(draw.randrange(0, 50))
        docs.append((k, t))
    return [*docs, (60, "ab " * 400), (61, "ab " * 300), (62, docs[3][1]), (63, shared[5] * 3)]


@pytest.mark.parametrize("seed", [256, 2])
def test_equals_brute_force(spark, seed):
    docs = random_docs(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert got(df) == brute([(d, t.encode()) for d, t in docs])


def test_documents_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = brute([(r.doc_id, (r.text or "").encode()) for r in df.collect()])
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.op3(spark, sf).collect()} == want


def test_text_over_several_pieces(monkeypatch):
    draw = random.Random(5)
    text = "".join(draw.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, text + text[100:900]), (2, "z" + text[2000:2500])]
    monkeypatch.setattr(S, "PIECE", 512)
    windows = set()
    for p in S.pieces([t.encode() for _, t in rows]):
        for i, s in enumerate(p.stretch):
            by = int(p.offset[s] - p.starts[s])
            windows |= {(int(p.text[s]), w + by) for w in range(int(p.first[i]), int(p.last[i]) + 1)}
    assert windows == {(k, w) for k, (_, t) in enumerate(rows) for w in range(len(t) - S.LENGTH + 1)}


def test_deep_shallow_order_and_prefixes():
    draw = random.Random(3)
    strings = [bytes(draw.choice(b"ab") for _ in range(draw.randrange(1, 100))) for _ in range(300)]
    strings += [strings[k][:80] + b"c" for k in range(50)] + [b"a" * 70 + bytes([draw.choice(b"ab")]) * draw.randrange(30) for _ in range(50)] + strings[:20]
    group = np.array([k % 3 for k in range(len(strings))])
    order, common = S.deep_shallow(strings, group, 100)
    pad = [s.ljust(104, b"\0") for s in strings]
    assert [(group[i], pad[i]) for i in order] == sorted((g, s) for g, s in zip(group, pad))
    for a, b, c in zip(order, order[1:], common[1:]):
        want = next((k for k in range(104) if pad[a][k] != pad[b][k]), 104) if group[a] == group[b] else -1
        assert c == want


def test_one_passage_in_many_surroundings(spark):
    """A passage that every document has, each with other text around it, cut at other places, and in two-byte characters."""
    draw = random.Random(17)
    part = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    passage = part(300)
    docs = [(k, part(40) + passage[draw.randrange(150) : 150 + draw.randrange(60, 150)] + part(40)) for k in range(1500)] + [(k, "é" * (30 + k % 90)) for k in range(1500, 1600)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert got(df) == brute([(d, t.encode()) for d, t in docs])


def test_rows_of_a_class_are_bounded():
    context = bytes(range(163))
    for before in (0, 7, 8, 31, 63):
        bands = list(S.bands_of(context[63 - before :], before))
        assert len(bands) <= S.BANDS and sum(len(t) - S.LENGTH + 1 for _, _, t in bands) == before + 1


def test_multikey_quicksort():
    draw = np.random.default_rng(4)
    table = draw.integers(0, 3, (500, 6)).astype(np.uint64)
    order = draw.permutation(500)
    group = np.sort(draw.integers(0, 7, 500))
    edge = np.r_[np.flatnonzero(np.r_[True, np.diff(group) != 0]), 500]
    parts = [set(order[a:b].tolist()) for a, b in zip(edge, edge[1:])]
    fresh = S.multikey_quicksort(table, order, edge[:-1], edge[1:], 4)
    for (a, b), part in zip(zip(edge, edge[1:]), parts):
        rows = [tuple(table[i, :4]) for i in order[a:b]]
        assert set(order[a:b].tolist()) == part and rows == sorted(rows)
        assert fresh[a:b].tolist() == [True, *(x != y for x, y in zip(rows, rows[1:]))]


def test_blind_trie():
    draw = random.Random(9)
    strings = [bytes(draw.choice(b"xyz") for _ in range(draw.randrange(0, 9))) for _ in range(200)]
    assert [strings[i] for i in S.BlindTrie(strings).order()] == sorted(strings)


def test_odd_rows_and_no_rows(spark, odd_docs, no_docs):
    out = S.remove_repeats(odd_docs).collect()
    assert len(out) == odd_docs.count()
    assert {(r.n_bytes, r.n_removed) for r in out if r.lang is None and r.n_bytes == 0} == {(0, 0)}
    assert S.remove_repeats(no_docs).count() == 0


def test_copies_ties_and_null_ids(spark):
    draw = random.Random(1)
    t = "".join(draw.choice("abcdef") for _ in range(250))
    df = spark.createDataFrame([(5, t), (5, t), (7, t), (None, t), (7, None)], "doc_id long, text string")
    rows = S.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", F.length("kept").alias("k")).collect()
    assert sorted((r.doc_id or 99, r.n_removed) for r in rows) == [(5, 0), (5, 0), (7, 0), (7, 250), (99, 250)]
