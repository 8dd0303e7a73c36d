import difflib
import itertools
import random
import re

import pytest

from docloom.operators import matching as M
from docloom.operators import similarity as S


def tokens(t):
    return re.findall("[a-z0-9]+", t.lower())


def shingles(w):
    return {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()


def scores(a, b):
    x, y = shingles(tokens(a)), shingles(tokens(b))
    j = len(x & y) / len(x | y) if x and y else 0.0
    return j, difflib.SequenceMatcher(None, tokens(a), tokens(b), autojunk=False).ratio()


def match(a, b):
    j, r = scores(a, b)
    return j >= 0.55 or r >= 0.70


def slow(rows):
    """(boilerplate rows with owners, copied pairs) by comparing every row with every other, both ways round."""
    owners = {}
    for d, k, t in rows:
        if tokens(t):
            owners[d, k] = len({e for e, _, u in rows if e != d and tokens(u) and match(t, u)}) + 1
    common = {x: n for x, n in owners.items() if n >= 3}
    pairs = set()
    for (d, k, t), (e, m, u) in itertools.product(rows, rows):
        if d < e and tokens(t) and tokens(u) and (d, k) not in common and (e, m) not in common and match(t, u):
            j, r = scores(t, u)
            pairs.add((d, k, e, m, round(j, 3), round(r, 3)))
    return common, pairs


def random_rows(seed):
    draw = random.Random(seed)
    vocab = [f"w{k}" for k in range(40)]
    base = [[draw.choice(vocab) for _ in range(draw.randrange(5, 14))] for _ in range(25)]
    rows = []
    for d in range(14):
        for k in range(8):
            w = list(draw.choice(base))
            for _ in range(draw.randrange(0, 4)):
                w[draw.randrange(len(w))] = draw.choice(vocab)
            if draw.random() < 0.2:
                w = [draw.choice("ab") for _ in range(draw.randrange(5, 9))]
            rows.append((d, k, " ".join(w)))
    boiler = "the system shall log each failed login attempt"
    rows += [(d, 20, boiler) for d in (1, 2, 3)] + [(4, 21, "all users must change their passwords every month"), (5, 21, "All users must change their passwords every month!")]
    return [*rows, (6, 30, "ééé ñññ üüü ööö äää"), (7, 30, "a b c d"), (8, 30, "a b c d"), (9, 31, rows[0][2]), (9, 32, rows[0][2])]


def near(got, want):
    return sorted((*g[:4], round(g[4], 2), round(g[5], 2)) for g in got) == sorted((*w[:4], round(w[4], 2), round(w[5], 2)) for w in want)


def test_copied_rows_equal_all_pairs(spark):
    for seed in (1, 2):
        rows = random_rows(seed)
        df = spark.createDataFrame(rows, "doc_id int, row_idx int, text string")
        common, pairs = slow(rows)
        pairs_of = S.list_pairs(df)
        got = S.boilerplate(df, pairs_of).collect()
        assert {tuple(r) for r in S.common_rows(df, pairs_of).collect()} == set(common)
        assert {(r.doc_id, r.row_idx): r.owners for r in got} == common
        copied = S.copied_rows(df)
        out = [(r.doc_a, r.row_a, r.doc_b, r.row_b, r.jaccard, r.structural_similarity) for r in copied.collect()]
        assert {o[:4] for o in out} == {p[:4] for p in pairs} and len(out) == len(pairs) > 5
        flags = {r.doc_id: set(r.others) for r in S.flagged(copied).collect()}
        want = {}
        for a, _, b, *_ in pairs:
            want.setdefault(a, set()).add(b)
            want.setdefault(b, set()).add(a)
        assert flags == want
        r = S.report(df, copied, S.boilerplate(df, S.list_pairs(df))).first()
        assert tuple(r)[:3] == (len({d for d, *_ in rows}), len(common), len(pairs))


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id int, row_idx int, text string")
    assert S.copied_rows(df).count() == 0 and S.boilerplate(df, S.list_pairs(df)).count() == 0


def name_tokens(s):
    return {t for t in re.split("[^A-Z]+", s.upper()) if len(t) > 1}


def name_similarity(a, b):
    x, y = name_tokens(a), name_tokens(b)
    return max(len(x & y) / len(x | y), difflib.SequenceMatcher(None, a, b).ratio()) if x and y else 0.0


def random_names(draw, n):
    given, last = ["Jane", "Jan", "MARY", "Doe", "Ann", "Rao", "Ananya", "Sharma", "Aarav", "José", "Li", "O'Neil"], ["Smith", "Smythe", "Rao", "Kumar", "K", "Kumari", "van Dyk", "Müller-Lee"]
    noise = lambda s: "".join(draw.choice("abcdez ") if draw.random() < 0.1 else c for c in s)
    return [noise(" ".join([draw.choice(given) for _ in range(draw.randrange(1, 3))] + [draw.choice(last)])) for _ in range(n)]


@pytest.mark.parametrize("least", [0.6, 0.85, 0.3])
def test_best_names_equal_all_pairs(spark, least):
    draw = random.Random(least)
    files = [*random_names(draw, 180), None, "É", "", "x", "Jane Rao" + " Smith" * 40, "Zzz Qqq"]
    members = [*random_names(draw, 120), None, "Ü", "Smith Smith " * 20 + "Jane", "JANE DOE", "DOE, JANE", "Jane Doe"]
    names = spark.createDataFrame([(k, s) for k, s in enumerate(files)] + [(1000, "doe jane"), (1001, "doe jane")], "file_id int, name string")
    roster = spark.createDataFrame([(k // 3, k % 3, s) for k, s in enumerate(members)], "team_ord int, member_ord int, member string")
    want = set()
    for k, s in [*enumerate(files), (1000, "doe jane"), (1001, "doe jane")]:
        best = max(((name_similarity(s, m), -i) for i, m in enumerate(members) if m is not None), default=(0, 0)) if s is not None else (0, 0)
        if best[0] >= least:
            want.add((k, -best[1] // 3, -best[1] % 3, members[-best[1]], best[0]))
    got = [(r.file_id, r.team_ord, r.member_ord, r.member, r.similarity) for r in M.best_names(names, roster, least).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 25
    pairs = {(r.name, r.member): r.similarity for r in M.name_pairs(names, roster, least).collect()}
    assert pairs == {(a, b): x for a in files + ["doe jane"] for b in members if a is not None and b is not None and (x := name_similarity(a, b)) >= least}


def test_names_of_none(spark):
    names, roster = spark.createDataFrame([], "file_id int, name string"), spark.createDataFrame([], "team_ord int, member_ord int, member string")
    assert M.best_names(names, roster).count() == 0


def test_occurrences_equal_a_search(spark, monkeypatch):
    monkeypatch.setattr(M, "GRAM_BITS", 256)  # most places pass
    draw = random.Random(5)
    letters = ["a", "b", "Ä", "中", " ", "1"]
    texts = ["".join(draw.choices(letters, k=draw.randrange(0, 60))) for _ in range(120)] + [None, "", "a"]
    patterns = ["".join(draw.choices(letters, k=draw.randrange(1, 12))) for _ in range(60)] + [texts[3][:25], texts[4], "", None, "aa", "中"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    df = spark.createDataFrame([(p, k) for k, p in enumerate(patterns)], "pattern string, offset int")
    got = sorted((r.doc_id, r.pattern, r.offset) for r in M.occurrences(docs, df).collect())
    assert got == sorted((d, p, k) for d, t in enumerate(texts) for k, p in enumerate(patterns) if t and p and p in t) and len(got) > 100
    assert M.occurrences(docs, df.limit(0)).count() == 0 and M.occurrences(docs.limit(0), df).count() == 0
    assert M.occurrences(docs, df.limit(0)).columns == ["doc_id", "pattern", "offset"]


def test_jaccard_pairs_write_less_than_hashes_of_all_shingles(spark, monkeypatch):
    """What is stored and joined of lines that are like no other is neither their shingles nor their texts."""
    stored, real = [], S.materialise
    monkeypatch.setattr(S, "materialise", lambda df, name: stored.append(real(df, name)) or stored[-1])
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = [(k, 0, " ".join(word() for _ in range(30))) for k in range(300)]
    rows += [(1000 + k, 0, rows[k][2] + " more") for k in range(3)]
    found = S.list_pairs(spark.createDataFrame(rows, "doc_id long, row_idx int, text string"), structural=False).where("a <> b").collect()
    assert len(found) == 3 and all(abs(r.jaccard - 26 / 27) < 1e-12 for r in found)
    assert sum(df.count() for df in stored) < 30


def test_batch_shingles_against_sets(spark):
    import pyarrow as pa

    from docloom.functions import shingled

    rng = random.Random(6)
    texts = [" ".join(rng.choices(["a", "bc", "d1", "éa", "x" * 30, "-"], k=rng.randrange(14))) for _ in range(300)] + ["", None, "a b", "a  b", "ab"]
    words = ["".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in t or "").split() for t in texts]
    sets = [set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set() for w in words]
    _, n = shingled.shingle_sets(pa.array(texts, pa.string()))
    assert n.tolist() == [len(s) for s in sets]
    # a slice, as of a batch that was cut
    assert shingled.shingle_sets(pa.array(texts, pa.string()).slice(7))[1].tolist() == [len(s) for s in sets[7:]]
    ids = shingled.list_ids.func(pa.array(texts, pa.string())).to_pylist()
    assert len({(i, tuple(w)) for i, w in zip(ids, words)}) == len(set(ids)) == len({tuple(w) for w in words})
    some = [k for k, w in enumerate(words) if w][:80]
    pairs = [(i, j) for i in some for j in some]
    got = shingled.jaccards.func(*(pa.array([texts[p[side]] for p in pairs], pa.string()) for side in (0, 1))).to_pylist()
    assert all(abs(g - len(sets[i] & sets[j]) / len(sets[i] | sets[j])) < 1e-12 for g, (i, j) in zip(got, pairs))
