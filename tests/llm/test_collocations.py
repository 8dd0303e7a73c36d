import re
from collections import Counter

import numpy as np
import pytest

from docloom.llm import collocations as C

from .oracle import assert_same


def brute(docs, least, longest=5, top=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    some = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, words), a in some.items():
        inside = lambda w: any(w[i : i + len(words)] == words for i in range(len(w) - len(words) + 1))
        if any(x == lang and len(w) > len(words) and b >= a and inside(w) for (x, w), b in some.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return sorted((lang, k, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1))


def rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_query_equals_sql(spark, sf):
    assert_same(spark, sf, C.op11, C.ORACLE)


@pytest.mark.parametrize("shard, group", [(16 << 20, 1 << 18), (500, 7)])
def test_equals_brute_force(spark, monkeypatch, shard, group):
    monkeypatch.setattr(C, "SHARD_BYTES", shard)
    monkeypatch.setattr(C, "GROUP", group)
    monkeypatch.setattr(C, "HELD", group)
    draw = np.random.default_rng(2)
    words, ends = ["The", "the", "of", "a", "Éa", "x", " ", "\x85z", "b'"], [" ", "  ", "\t", ", ", ".", "\n", "\x0b", " ", " ", " "]
    docs = [(draw.choice(["en", "de", None, "und"]), "".join(f"{draw.choice(words)}{draw.choice(ends)}" for _ in range(int(draw.integers(1, 120))))) for _ in range(60)]
    docs += [("en", "the the the the the the the the the the"), ("en", None), (None, ""), ("fr", " ,. "), ("de", "one"), ("en", "p q r s t u v"), ("en", "p q r s t u v"), ("en", "w.p q r s t u v")]
    df = spark.createDataFrame([(lang if lang is None else str(lang), t, 1, "x") for lang, t in docs], "lang string, text string, n int, phrase string").repartition(3)
    for least in (3, 12):
        assert rows(C.collocations(df, least)) == brute(docs, least)
    assert rows(C.collocations(df, 5, longest=3, top=4)) == brute(docs, 5, 3, 4)


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    draw = np.random.default_rng(3)
    docs = [("en", " ".join(f"w{k}" for k in draw.integers(0, 40, 300))) for _ in range(20)]
    df = spark.createDataFrame(docs, "lang string, text string")
    monkeypatch.setattr(C.Filter, "holds", lambda self, h: np.ones(len(h), bool))
    assert rows(C.collocations(df, 4)) == brute(docs, 4)


def test_filter_holds_its_keys(spark, tmp_path):
    keys = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 5000)
    f = C.filter_of(spark.createDataFrame([(int(k),) for k in keys], "hash long"), C.Store(f"file://{tmp_path}"), "f")
    assert f.holds(keys.view(np.uint64)).all()
    assert f.holds(np.random.default_rng(1).integers(0, 2**64, 20_000, np.uint64)).mean() < 0.02


def test_odd_rows_and_no_rows(spark, odd_docs, no_docs):
    assert rows(C.collocations(odd_docs, 2)) == brute([(r.lang, r.text) for r in odd_docs.collect()], 2)
    assert C.collocations(no_docs, 2).count() == 0


def test_products_of_more_than_64_bits(spark, monkeypatch):
    f = spark.createDataFrame([("en", "a", 1, 3 * 10**12), ("en", "b", 1, 2 * 10**12), ("en", "a b", 2, 10**12 + 7)], "lang string, phrase string, size int, f long")
    monkeypatch.setattr(C, "frequent", lambda *_: (f, spark.createDataFrame([("en", 10**14 + 3)], "lang string, n long")))
    got = C.collocations(f).collect()
    assert [r.score for r in got] == [1000 * (10**12 + 7) * (10**14 + 3) // (6 * 10**24)]
