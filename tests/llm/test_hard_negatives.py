import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import hard_negatives as H

from .oracle import assert_same

GIVEN = "vec_id long, embedding array<float>, label int, rank string, v map<string,int>"


def test_query_equals_sql(spark, sf):
    assert_same(spark, sf, H.op12, H.ORACLE)


def brute(rows, step, k=5, m=3):
    whole = [(i, c, [math.floor(256 * float(np.float32(x))) for x in v]) for i, c, v in rows]
    out = []
    for a, (i, c, v) in enumerate(whole):
        if i % step:
            continue
        score = [(-sum(x * y for x, y in zip(v, w)), j, d) for b, (j, d, w) in enumerate(whole) if b != a and len(w) == len(v)]
        for p, j, _ in sorted(x for x in score if x[2] == c)[:k]:
            near = sorted(x for x in score if x[2] != c and 50 * -p <= 100 * -x[0] <= 95 * -p)[:m]
            out += [(i, j, rank, n, -p, -s) for rank, (s, n, _) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("rows, block", [(8192, 512), (16, 3)])
def test_ties_nulls_repeated_rows_and_parts(spark, monkeypatch, rows, block):
    monkeypatch.setattr(H, "BUCKET_ROWS", rows)
    monkeypatch.setattr(H, "BLOCK", block)
    draw = np.random.default_rng(0)
    good = [(k, int(draw.integers(4)), [float(x) for x in draw.choice([-1.0, -0.25, 0.0, 0.5, 2.0], 5)]) for k in range(250)]
    good += [(300 + k, 1, [1.0] * 5) for k in range(60)] + [(400 + k, k % 2, [0.5, 1.0]) for k in range(6)] + [(20, 2, [1.0] * 5)] * 3 + [(50, 9, [1.0] * 5), (60, 3, [0.0] * 5), (970, 3, [7.0, 1.0, 1.0])]
    bad = [(500, 1, None), (None, 1, [1.0] * 5), (510, None, [1.0] * 5), (600, 1, [1.0, None, 1.0, 1.0, 1.0]), (700, 1, [1.0, float("nan"), 0.0, 0.0, 0.0]), (800, 1, [float("inf")] * 5), (900, 1, [])]
    df = spark.createDataFrame([(i, v, c, "x", {"a": 1}) for i, c, v in good + bad], GIVEN).repartition(3)
    got = sorted(tuple(r) for r in H.mine(df, F.col("vec_id") % 10 == 0, F.col("label")).collect())
    assert got == brute(good, 10) and len({r[4] for r in got}) > 5


def test_random_vectors(spark):
    draw = np.random.default_rng(4)
    rows = [(k, int(draw.integers(10)), (draw.normal(size=8) * draw.gamma(2.0)).astype(np.float32).tolist()) for k in range(600)]
    df = spark.createDataFrame([(i, v, c, None, None) for i, c, v in rows], GIVEN)
    assert sorted(tuple(r) for r in H.mine(df, F.col("vec_id") % 20 == 0, F.col("label")).collect()) == brute(rows, 20)


def test_buckets_are_pruned_and_large_scores_exact():
    draw = np.random.default_rng(1)
    for grown in (1, 1 << 16):
        v = (draw.normal(size=(4000, 8)) * draw.gamma(1.0, size=(4000, 1)) * 256).astype(np.int64) * grown
        label = draw.integers(5, size=4000)
        order = np.argsort(-(v.astype(float) ** 2).sum(1))
        cut = [np.sort(c) for c in np.array_split(order, 40)]
        cut = [c[np.argsort(label[c], kind="stable")] for c in cut]
        loads = [((v[c].astype(float) ** 2).sum(1).max(), lambda c=c: (v[c], np.stack([c, c, label[c]]))) for c in cut]
        ask = order[100:1000:90]
        positives, negatives, reads = H.search(v[ask], ask, label[ask], lambda: iter(loads))
        assert max(reads) < 25
        for a, top, tops in zip(ask, positives, negatives):
            s = v @ v[a]
            assert top == sorted((-int(s[j]), int(j)) for j in np.flatnonzero(label == label[a]) if j != a)[:5]
            for (p, _), got in zip(top, tops):
                assert got == sorted((-int(s[j]), int(j)) for j in np.flatnonzero(label != label[a]) if 50 * -p <= 100 * int(s[j]) <= 95 * -p)[:3]


def test_no_rows_and_too_large(spark):
    df = spark.createDataFrame([], GIVEN)
    assert H.mine(df, F.col("vec_id") % 2 == 0, F.col("label")).count() == 0
    with pytest.raises(OverflowError):
        H.mine(spark.createDataFrame([(1, [3e15, 1.0], 1, None, None)], GIVEN), F.lit(True), F.col("label"))
