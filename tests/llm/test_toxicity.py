import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from docloom.llm import toxicity as X

from .conftest import fold


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = X.op5(spark, sf).select("doc_id", "held_out", "score", "predicted").collect()
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.score, r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    bad, good = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc > 0.95
    assert sum(p for _, p, y in held if y) / len(bad) > 0.85 and sum(p for _, p, y in held if not y) / len(good) < 0.03


def test_neighbours_equal_brute_force():
    draw = np.random.default_rng(3)
    examples = []
    for k in range(700):
        at = np.sort(np.unique(np.minimum(draw.geometric(0.15, draw.integers(0, 9)), 40) - 1))
        x = draw.random(len(at)) + 0.1
        examples.append((int(k * 7 % 701), int(draw.random() < 0.3), at, x / (np.linalg.norm(x) or 1)))
    index = X.Index(np.arange(40), np.ones(40), np.ones(40))
    index.build(examples)
    assert 0 < (index.often >= 0).sum() <= 40
    for _ in range(100):
        at = np.sort(draw.choice(40, draw.integers(1, 5), replace=False))
        x = draw.random(len(at))
        x /= np.linalg.norm(x)
        all_ = []
        for d, _, ea, ex in examples:
            c = sum(ex[list(ea).index(t)] * w for t, w in zip(at, x) if t in ea)
            if c > 0:
                all_.append((-round(c, 12), d))
        rows, cosines = index.nearest(at, x, 12)
        assert [(-c, int(index.ids[r])) for r, c in zip(rows, cosines)] == sorted(all_)[:12]


def test_evidence_odd_rows_and_no_rows(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(k, ("you are a moron " if k % 4 == 0 else "you are a fine friend ") + str(k)) for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)] + [(None, 1), (3, None), (4, 0)], "doc_id long, toxic int")
    index = X.train(docs, labels)
    (bad, why), (good, none) = index.score("What a MORON!"), index.score("hello")
    assert bad > 0.7 > 0.3 > good and all(y == 1 and c > 0 for _, c, y in why) and not none
    rows = X.score(odd_docs, index).collect()
    assert len(rows) == odd_docs.count() and all(r.score == index.empty for r in rows if not r.text)
    assert X.score(no_docs, index).count() == 0
    bare = X.train(docs, labels.limit(0))
    assert 0 <= bare.score("anything")[0] < 0.3


def plain_terms(text):
    words = Counter(re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode()))
    out = Counter({b"w" + w: n for w, n in words.items()})
    for w, n in words.items():
        if len(w) > X.PREFIX:
            out[b"b" + w[: X.PREFIX]] += n
    return out


def test_query_against_brute_force(spark, sf):
    """Neighbours, evidence and scores of the query by plain cosines of all pairs of document and example."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if fold(r.doc_id, 4) != 2}
    found = {r.doc_id: plain_terms(r.text) for r in docs}
    df = Counter(t for f in found.values() for t in f)
    labelled = {d: int(toxic[d] > 0) for d in found if d in toxic}
    assert len(labelled) <= X.MAX_EXAMPLES
    n, bad = Counter(t for d in labelled for t in found[d]), Counter(t for d, y in labelled.items() if y for t in found[d])
    total, n_bad = len(labelled), sum(labelled.values())

    def weight(t):
        a, r = bad[t], n[t]
        bottom = r * n_bad * (total - r) * (total - n_bad)
        chi2 = total * (a * total - r * n_bad) ** 2 / bottom if bottom else 0
        lift = ((a + 0.5) / (r + 1)) / ((n_bad + 0.5) / (total + 1))
        telling = chi2 >= min(X.CHI2, 0.25 * total) and (lift >= X.LIFT or lift <= 1 / X.LIFT)
        return (math.log((1 + len(docs)) / (1 + df[t])) + 1) * (X.GAIN if telling else 1)

    def vector(d):
        v = {t: (1 + math.log(c)) * weight(t) for t, c in found[d].items() if n[t]}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = {d: vector(d) for d in found}
    bare = [y for d, y in labelled.items() if not vectors[d]]
    empty = (sum(bare) + 0.5) / (len(bare) + 50)

    def near(d, but=None):
        v = vectors[d]
        all_ = sorted((-round(sum(x * vectors[e].get(t, 0) for t, x in v.items()), 12), e) for e in labelled if e != but)
        return [(e, -c) for c, e in all_ if c < 0][: X.NEIGHBOURS]

    def vote(found):
        w = [1 / (X.SOFT + 1 - min(c, 1)) for _, c in found]
        return (sum(x * labelled[e] for x, (e, _) in zip(w, found)) + empty) / (sum(w) + 1)

    full = [d for d in labelled if vectors[d]]
    scale, shift = X.calibration(np.array([vote(near(d, d)) for d in full]), np.array([float(labelled[d]) for d in full]))
    for r in X.op5(spark, sf).collect():
        mine = near(r.doc_id)
        assert [(e.doc_id, e.label) for e in r.evidence] == [(e, labelled[e]) for e, _ in mine]
        assert [e.cosine for e in r.evidence] == pytest.approx([c for _, c in mine], abs=1e-9)
        assert bool(mine) == any(n[t] for t in found[r.doc_id])
        p = min(max(vote(mine), 1e-4), 1 - 1e-4)
        assert r.score == pytest.approx(1 / (1 + math.exp(-(scale * math.log(p / (1 - p)) + shift))) if mine else empty, abs=1e-6)


def test_calibration_is_finite_and_least():
    draw = np.random.default_rng(1)
    for votes, labels in ((np.r_[np.zeros(500), np.ones(3)], np.r_[np.zeros(500), np.ones(3)]), (draw.random(400), (draw.random(400) < 0.3) * 1.0), (draw.random(50), np.zeros(50))):
        with np.errstate(over="raise", invalid="raise", divide="raise"):
            a, b = X.calibration(votes, labels)
        assert np.isfinite([a, b]).all() and a > 0


def test_terms_hash_words_and_beginnings():
    keys, n = X.terms("Moron moronic, a MORON!")
    want = {xxhash.xxh64_intdigest(w, k) >> 1: c for w, k, c in ((b"moron", 1, 2), (b"moronic", 1, 1), (b"a", 1, 1), (b"moro", 2, 3))}
    assert dict(zip(keys.tolist(), n.tolist())) == want and (np.diff(keys) > 0).all()
