import random

import numpy as np
import pytest

import corpus_pipeline
from docloom.llm import near_copies as C


def jaccard_groups(texts):
    """Least id of each id's component, by all pairs of five-word shingle sets."""
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, b in enumerate(ids):
        for a in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or 9 * both >= 4 * (len(sets[a]) + len(sets[b])) and both:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_stage_keeps_one_of_each_jaccard_group(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = jaccard_groups({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()} == set(want.values())


@pytest.mark.parametrize("block", [2048, 3])
def test_recall_of_edited_copies_and_chains(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    draw = random.Random(11)
    word = lambda: f"w{draw.randrange(3000)}"
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(draw.randrange(20, 150))] + passage * draw.randrange(2)
        for _ in range(12):
            t = list(base)
            for k in draw.sample(range(len(t)), draw.randrange(0, max(2, len(t) // 30))):
                t[k] = word()
            texts.append(" ".join(t))
            if draw.random() < 0.5:
                base = t  # a chain: the ends are less similar than 0.8
    texts += ["", " ", None, "one two", "ONE  two", "one two three four five", "one two three four five six"]
    rows = list(enumerate(texts))
    want = jaccard_groups(dict(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = C.groups(docs).collect()
    least = {}
    for r in found:
        least[r.root] = min(least.get(r.root, r.doc_id), r.doc_id)
    assert len(found) == len(rows) and {r.doc_id: least[r.root] for r in found} == want
    assert 20 < len(set(want.values())) < len(rows)


def test_odd_rows_and_no_rows(spark, odd_docs, no_docs):
    assert C.groups(odd_docs).count() == odd_docs.count()
    assert C.groups(no_docs).count() == 0


def test_parities_bound_differences():
    draw = np.random.default_rng(0)
    for k in range(60):
        a = np.unique(draw.integers(-(1 << 63), 1 << 63, draw.integers(1, 3000)))
        keep, more = draw.choice([0.2, 0.8, 0.9, 0.97]), draw.integers(0, 40)
        b = np.unique(np.r_[a[draw.random(len(a)) < keep], draw.integers(-(1 << 63), 1 << 63, more)])
        n = min(len(C.parities(a)), len(C.parities(b)))
        differ = np.bitwise_count((C.folded(C.parities(a), n) ^ C.folded(C.parities(b), n)).view(np.uint64)).sum()
        assert differ <= len(np.setxor1d(a, b)) and len(C.parities(a)) % C.PARITIES == 0
        assert not C.similar(a, b) or C.may_be_similar(C.parities(a), C.parities(b), len(a) + len(b))
    long, other = (np.unique(draw.integers(-(1 << 63), 1 << 63, 5000)) for _ in range(2))
    assert not C.may_be_similar(C.parities(long), C.parities(other), len(long) + len(other))


def test_large_group_of_near_copies(spark):
    """Copies of one text with a few words changed each; many are similar to the text, few to each other."""
    draw = random.Random(3)
    base = [f"w{draw.randrange(5000)}" for _ in range(120)]
    texts = []
    for _ in range(150):
        t = list(base)
        for k in draw.sample(range(len(t)), draw.randrange(0, 7)):
            t[k] = f"x{draw.randrange(100_000)}"
        texts.append(" ".join(t))
    rows = list(enumerate(texts))
    want = jaccard_groups(dict(rows))
    found = C.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    least = {}
    for r in found:
        least[r.root] = min(least.get(r.root, r.doc_id), r.doc_id)
    assert {r.doc_id: least[r.root] for r in found} == want and 1 < len(set(want.values())) < 120


def test_pages_of_one_template_meet_no_more_than_they_must(spark, monkeypatch):
    """Pages that share 100 words and have 15 of their own aren't similar, and none is compared with all others."""
    draw = random.Random(4)
    word = lambda: f"w{draw.randrange(10**6)}"
    template = " ".join(word() for _ in range(100))
    pages = [f"{template} {' '.join(word() for _ in range(15))}" for _ in range(300)]
    rows = list(enumerate([*pages, pages[7] + " end"]))
    seen = []
    verified = C._verified
    monkeypatch.setattr(C, "_verified", lambda pairs, *rest: (seen.append(pairs.count()), verified(pairs, *rest))[1])
    found = C.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len({r.root for r in found}) == len(rows) - 1 and seen[1] < len(rows)
