import math
import unicodedata

import numpy as np
import pytest

from docloom.llm import language_id as L

from .conftest import fold


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = L.op6(spark, sf).collect()
    assert len(rows) == len(truth) and all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_most_weights_of_seen_features_are_zero(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null").select("text", "lang").collect()
    rows = [(r.lang, *L.features(r.text)) for r in rows]
    m, seen = L.fit(rows), np.zeros(1 << L.DIM_BITS, bool)
    for _, at, _ in rows:
        seen[at] = True
    assert (m.weights[seen] == 0).mean() > 0.6


def test_model_is_calibrated_and_repeats():
    text = {"en": "the cat and the dog run with that thing", "fr": "le chat et le chien qui est dans la rue", "de": "der hund und die katze sind nicht hier"}
    rows = [(k, *L.features(" ".join(v.split()[i % 5 :]) + str(i))) for k, v in text.items() for i in range(30)]
    m = L.fit(rows)
    assert 0 < m.temperature < 50
    assert [m.predict(v)[0] for v in text.values()] == list(text)
    assert L.fit(rows).weights.tolist() == m.weights.tolist()


def test_features_are_damped_counts_of_ngrams():
    at, tf = L.features("ABAB")
    assert len(at) == 6 and sorted(round(x, 3) for x in tf) == [1.0, 1.0, 1.0, 1.693, 1.693, 1.693]  # a b ab ba aba bab
    assert all(len(L.features(t)[0]) == 0 for t in (None, "", " 12 !?", "…—"))


def test_odd_rows_and_no_rows(spark, odd_docs, no_docs):
    m = L.train(odd_docs)
    rows = L.identify(odd_docs, m).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if not any(c.isalpha() for c in r.text or ""))
    empty = L.train(no_docs)
    assert {r.lang_pred for r in L.identify(odd_docs, empty).collect()} == {"und"} and L.identify(no_docs, m).count() == 0


def test_training_starts_no_second_set_of_workers(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"the cat and the dog {k}" if k % 2 else f"der hund und die katze {k}", "en" if k % 2 else "de") for k in range(40)], "doc_id long, text string, lang string")

    def python_rows(*_, **__):
        raise AssertionError("rows of Python objects get workers of their own")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", python_rows)
    model = L.train(docs)
    assert model.langs == ["de", "en"] and model.predict("the cat and the dog")[0] == "en" and model.predict("der hund und die katze")[0] == "de"


def slow_features(text):
    """N-gram counts by plain numbers: lower-case letters and marks, runs of others as one space."""
    kept, last = [], None
    for c in text.lower():
        c = ord(c) if unicodedata.category(c)[0] in "LM" else 32
        if c != 32 or last != 32 or last is None:
            kept.append(c)
        last = c
    k, low, out = [int(x) for x in L._K], (1 << 32) - 1, {}
    for n in (1, 2, 3):
        for i in range(len(kept) - n + 1):
            g = kept[i : i + n]
            if n == 1 and g[0] == 32:
                continue
            h = g[0] * k[0] & low
            two = ((h ^ (g[1] * k[1] & low)) * k[2] & low) if n > 1 else 0
            h = h ^ 1 if n == 1 else two ^ 2 if n == 2 else (two ^ (g[2] * k[0] & low)) * k[1] & low
            h = ((h ^ (h >> 15)) * k[1] & low) >> (32 - L.DIM_BITS)
            out[h] = out.get(h, 0) + 1
    return out if any(unicodedata.category(c)[0] == "L" for c in text) else {}


def test_query_against_brute_force(spark, sf):
    """Every prediction of the query by plain sums over the model's weights; document frequencies by counting."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    m = L.train(L.learnt_rows(spark.read.parquet(f"{sf}/documents.parquet")))
    df, n = {}, 0
    for r in docs:
        if fold(r.doc_id, 5) and r.lang is not None and r.text is not None:
            n += 1
            for k in slow_features(r.text):
                df[k] = df.get(k, 0) + 1
    assert np.allclose(m.idf, [math.log((1 + n) / (1 + df.get(k, 0))) + 1 for k in range(len(m.idf))])
    got = {r.doc_id: r for r in L.op6(spark, sf).collect()}
    for r in docs:
        x = {k: (1 + math.log(c)) * m.idf[k] for k, c in slow_features(r.text or "").items()}
        if not x:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        norm = math.sqrt(sum(v * v for v in x.values()))
        z = [(sum(v * m.weights[k][j] for k, v in x.items()) / norm + m.bias[j]) / m.temperature for j in range(len(m.langs))]
        p = [math.exp(v - max(z)) for v in z]
        best = max(range(len(z)), key=lambda j: p[j])
        assert got[r.doc_id].lang_pred == m.langs[best] and got[r.doc_id].score == pytest.approx(p[best] / sum(p), abs=1e-9)


def test_texts_without_letters():
    m = L.fit([(k, *L.features(t * 5)) for k, t in (("en", "the cat "), ("de", "der hund ")) for _ in range(20)])
    assert all(m.predict(t) == ("und", 0.0) for t in ("€€€ 2024", "→ 12", "😀😀", "٣٤٥", "①②", "", None, " \n"))
    assert all(m.predict(t)[0] in m.langs for t in ("ª", "µ", "º", "日本語", "ก็"))


def test_temperature_is_where_the_loss_is_least():
    draw = np.random.default_rng(2)
    z, y = draw.normal(0, 9, (200, 3)), draw.integers(0, 3, 200)
    z[np.arange(200), y] += 4
    n = len(y)
    target = np.full(z.shape, 1 / (n + 2) / 2)
    target[np.arange(n), y] = 1 - 1 / (n + 2)
    loss = lambda t: -(target * np.log(L._softmax(z / t))).sum()
    t = L._temperature(z, y)
    assert all(loss(t) <= loss(t * k) + 1e-9 for k in (0.5, 0.9, 0.99, 1.01, 1.1, 2))
    sure = np.eye(3)[y] * 40  # all right: the targets keep it finite
    assert 0.05 < L._temperature(sure, y) < 50


def test_one_language_and_too_many(spark, monkeypatch):
    one = spark.createDataFrame([(k, f"nur ein wort {k}", "de") for k in range(5)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in L.identify(one, L.train(one)).collect()} == {"de"}
    monkeypatch.setattr(L, "MAX_LANGS", 2)
    many = spark.createDataFrame([(k, "abc", f"l{k}") for k in range(3)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        L.train(many)
