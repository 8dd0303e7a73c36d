import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from docloom.llm import ngram_lm as N
from docloom.llm import sorted_arrays as A

from .conftest import fold


def modified(counts):
    """Discounts of counts 1, 2 and more from the counts of counts; half a unit where these can't tell."""
    n = [sum(1 for c in counts if c == k) for k in (1, 2, 3, 4)]
    if not n[0] or not n[1]:
        return lambda c: 0.5 if c else 0.0
    y = n[0] / (n[0] + 2 * n[1])
    d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 0.5]
    d = [min(max(x, 0.05), top) for x, top in zip(d, (0.95, 1.9, 2.9))]
    return lambda c: d[min(c, 3) - 1] if c else 0.0


class Slow:
    """The model by plain counting: of the highest order, counts; below, distinct words before."""

    def __init__(self, texts, order=3):
        self.order, self.c = order, Counter()
        self.counts = [Counter() for _ in range(order + 1)]
        for t in texts:
            w = [*self.tokens(t), None]
            self.c.update(w)
            padded = [0] * (order - 1) + w
            self.counts[order].update(tuple(padded[k : k + order]) for k in range(len(w)))
        for m in range(order - 1, 0, -1):
            self.counts[m] = Counter(g[1:] for g in self.counts[m + 1])
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.d = [modified(c.values()) for c in self.counts]
        self.total, self.down = defaultdict(int), defaultdict(float)
        for m in range(1, order + 1):
            for g, k in self.counts[m].items():
                self.total[m, g[:-1]] += k
                self.down[m, g[:-1]] += self.d[m](k)

    @staticmethod
    def tokens(t):
        return (t or "").encode().lower().split()

    def p(self, gram):
        m = len(gram)
        below = 1 / (self.v + 1) if m == 1 else self.p(gram[1:])
        if not self.total[m, gram[:-1]]:
            return below
        k = self.counts[m][gram]
        return (k - self.d[m](k) + self.down[m, gram[:-1]] * below) / self.total[m, gram[:-1]]

    def row(self, t):
        w = [*self.tokens(t), None]
        base = sum(math.log10((self.c[x] + 0.5) / (self.n + 0.5 * (self.v + 1))) for x in w)
        padded = [0] * (self.order - 1) + w
        mine = sum(math.log10(self.p(tuple(padded[k : k + self.order]))) for k in range(len(w)))
        return len(w), sum(self.c[x] > 0 for x in w), self.n, base, mine


def same(rows, slow):
    for r in rows:
        assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == pytest.approx(slow.row(r.text), rel=1e-9)


def test_documents_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    slow = Slow([t for d, t in texts.items() if fold(d, 5) != 1])
    rows = N.op10(spark, sf).collect()
    assert len(rows) == len(texts) and all(r.held_out == (fold(r.doc_id, 5) == 1) for r in rows)
    for r in rows:
        assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == pytest.approx(slow.row(texts[r.doc_id]), rel=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_sum_to_one(order):
    draw = random.Random(1)
    slow = Slow([" ".join(draw.choice("abcdefgh") for _ in range(draw.randrange(30))) for _ in range(40)], order)
    for context in ((0,), (b"a",), (b"h",), (b"unseen",)):
        context = (0,) * (order - 2) + context
        assert sum(slow.p((*context, b)) for b in slow.c) + slow.p((*context, b"unseen")) == pytest.approx(1)


@pytest.mark.parametrize("order", [2, 3])
def test_small_corpora_and_odd_rows(spark, odd_docs, no_docs, order):
    draw = random.Random(2)
    rows = [(k, " ".join(draw.choice("aa Bb c dd é the THE".split()) for _ in range(draw.randrange(20)))) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(N.score(docs, N.train(docs, order)).collect(), Slow([t for _, t in rows], order))
    odd = [r.text for r in odd_docs.collect()]
    same(N.score(odd_docs, N.train(odd_docs, order)).collect(), Slow(odd, order))
    same(N.score(odd_docs, N.train(no_docs, order)).collect(), Slow([], order))
    assert N.score(no_docs, N.train(docs, order)).count() == 0


def test_pieces_dealt_in_two_steps(spark, monkeypatch):
    monkeypatch.setattr(N, "HOP_BITS", 2)
    draw = random.Random(4)
    rows = [(k, " ".join(draw.choice("abcdefghijk") for _ in range(draw.randrange(40)))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(N.score(docs, N.train(docs)).collect(), Slow([t for _, t in rows]))


def test_keys_of_pairs_differ():
    for bits in (2, 3, 17, 32):
        a, b = np.unique(np.random.default_rng(0).integers(0, 1 << bits, (2, 1000)), axis=1)
        assert len(np.unique(N.Keys(bits).pair(a, b))) == a.size


@pytest.mark.parametrize("bits", [20, 30])
def test_sums_of_rows(bits):
    draw = np.random.default_rng(5)
    cols = [draw.integers(0, 5, 400) + (1 << (bits - 1)) for _ in range(3)]
    n = draw.integers(1, 9, 400)
    want, once = Counter(), Counter()
    for *g, k in zip(*cols, n):
        want[tuple(map(int, g))] += int(k)
        once[tuple(map(int, g))] += 1
    ids, (sums,) = N._summed(cols, [n], bits)
    assert list(zip(*(c.tolist() for c in ids))) == sorted(want) and sums.tolist() == [want[g] for g in sorted(want)]
    ids, (sums,) = N._summed(cols, [], bits)
    assert list(zip(*(c.tolist() for c in ids))) == sorted(once) and sums.tolist() == [once[g] for g in sorted(once)]
    assert [len(c) for c in N._summed([cols[0][:0]] * 3, [n[:0]], bits)[0]] == [0, 0, 0]


def test_sums_of_rows_that_are_sorted_by_their_hashes():
    draw = np.random.default_rng(6)
    cols = [draw.integers(0, 5, 400) + (1 << 29) for _ in range(3)]
    n = draw.integers(1, 9, 400)
    want = Counter()
    for *g, k in zip(*cols, n):
        want[tuple(map(int, g))] += int(k)
    for key in (N.Keys(30).row(cols), np.zeros(400, np.uint64), (cols[0] & 1).astype(np.uint64)):  # told apart by all, none or some of the hashes
        ids, (sums,) = N._summed(cols, [n], 30, key)
        assert dict(zip(zip(*(c.tolist() for c in ids)), sums.tolist())) == want and len(sums) == len(want)


@pytest.mark.parametrize("top", [9, 1 << 30, 1 << 62])
def test_rows_in_one_number(top):
    draw = np.random.default_rng(7)
    cols = [draw.integers(0, 4, 500) * (top // 4) for _ in range(4)]
    key = N._packed(cols)
    rows = list(zip(*(c.tolist() for c in cols)))
    assert [rows[k] for k in np.argsort(key, kind="stable")] == sorted(rows) and len(set(key.tolist())) == len(set(rows))


def test_words_of_large_numbers_are_counted_without_sorts_of_columns(monkeypatch):
    def refused(*_, **__):
        raise AssertionError("columns are sorted one after the other")

    class Large:
        """Numbers of 30 bits, so that no three fit in 63."""

        START, END, keys, bits = N.Vocabulary.START, N.Vocabulary.END, N.Keys(30), 30

        def numbers(self, hashes):
            return (1 << 29) + (hashes & ((1 << 29) - 1))

    texts = ["a b c a b c", "a b", "", None, "c a b"]
    batch = lambda: iter([N.pa.record_batch([N.pa.array(texts, N.pa.string())], ["text"])])
    monkeypatch.setattr(N.np, "lexsort", refused)
    pieces = list(N._count_grams(Large(), 3, 3)(batch()))
    second, third, first, n = N._joined([p for b in pieces for p in b.column("piece").to_pylist()])
    names = {int(Large().numbers(N.encode(N.pa.array([w]))[0])[0]): w for w in "abc"} | {Large.START: "<", Large.END: ">"}
    have = {tuple(names[int(x)] for x in g): int(k) for *g, k in zip(first, second, third, n)}
    want = Counter(g for t in texts for w in [["<", "<", *(t or "").split(), ">"]] for g in zip(w, w[1:], w[2:]))
    assert have == want


def test_packed_columns_come_back():
    draw = np.random.default_rng(0)
    keys = np.sort(draw.integers(0, 1 << 63, 500).astype(np.uint64)) << np.uint64(1)
    cols = [draw.integers(0, top, 500) for top in (1, 2, 300, 1 << 40)]
    back = A.unpack(A.pack(keys, *cols))
    assert all((x == y).all() for x, y in zip(back, [keys, *cols])) and len(back) == 5


def test_hashed_values(tmp_path):
    draw = np.random.default_rng(1)
    keys = np.unique(draw.integers(0, 1 << 62, 4000).astype(np.uint64) << np.uint64(2))
    values = draw.integers(0, 70_000, len(keys))
    h = A.Hashed(A.Store(str(tmp_path)), "x", 3)
    for p in range(8):
        mine = (keys >> np.uint64(61)) == p
        h.put(p, keys[mine], n=values[mine], few=values[mine] % 3)
    n, few = h.look(keys, "n", "few")
    assert (n == values).all() and (few == values % 3).all()
    other = np.setdiff1d(np.unique(keys ^ np.uint64(1 << 30)), keys)
    assert not h.look(other, "n")[0].any()
