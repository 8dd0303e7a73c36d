import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import va_file as V

from .oracle import assert_same

def query():
    return F.col("vec_id") % 20 == 0


def test_query_equals_sql(spark, sf):
    assert_same(spark, sf, V.op8, V.ORACLE)


def brute(rows, k):
    whole = lambda v: [math.floor(1024 * float(np.float32(x))) for x in v]
    out = []
    for j, (q, v) in enumerate(rows):
        if q % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(whole(v), whole(c))), i) for n, (i, c) in enumerate(rows) if n != j and len(c) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("rows", [16_384, 7])
def test_ties_nulls_repeated_rows_and_parts(spark, monkeypatch, rows):
    monkeypatch.setattr(V, "PART_ROWS", rows)
    draw = np.random.default_rng(0)
    good = [(k, [float(x) for x in draw.choice([-1.0, -0.25, 0.0, 0.5, 2.0], 5)]) for k in range(300)]
    good += [(300 + k, [1.0] * 5) for k in range(40)] + [(400 + k, [0.5, 1.0]) for k in range(3)] + [(20, [1.0] * 5), (20, [1.0] * 5), (33, [2.0] * 5), (960, [7.0, 1.0, 1.0])]
    bad = [(500, None), (None, [1.0] * 5), (600, [1.0, None, 1.0, 1.0, 1.0]), (700, [1.0, float("nan"), 0.0, 0.0, 0.0]), (800, [float("inf")] * 5), (900, [])]
    df = spark.createDataFrame([(*r, "x", {"a": 1}) for r in good + bad], "vec_id long, embedding array<float>, rank string, query map<string,int>").repartition(3)
    assert sorted(tuple(r) for r in V.top_k(df, query(), 10).collect()) == brute(good, 10)


def test_few_exact_vectors_are_read():
    draw = np.random.default_rng(1)
    v = (draw.normal(size=(20_000, 16)) * 1024).astype(np.int64)
    cells = V.Approximation(v.min(0), v.max(0))
    codes = cells.encode(v)
    assert codes.dtype == np.uint8 and codes.max() < V.CELLS
    assert (cells.bounds(codes, v[:5]) >= v[:5] @ v.T).all()
    best, read = V.search(v[:5], np.arange(5), codes, v, np.arange(len(v)), cells, 10)
    assert read < 0.1 * 5 * len(v)
    for i in range(5):
        s = v @ v[i]
        assert best[i] == sorted((-int(s[j]), j) for j in range(len(v)) if j != i)[:10]


def test_all_rows_alike_and_few_rows():
    v = np.full((300, 3), 5, np.int64)
    cells = V.Approximation(v.min(0), v.max(0))
    best, _ = V.search(v[:1], np.array([7]), cells.encode(v), v, np.arange(300), cells, 4)
    assert best == [[(-75, 0), (-75, 1), (-75, 2), (-75, 3)]]
    best, _ = V.search(v[:1], np.array([-1]), cells.encode(v[:2]), v[:2], np.arange(2), cells, 4)
    assert best == [[(-75, 0), (-75, 1)]]
    best, _ = V.search(v[:1], np.array([0]), cells.encode(v[:1]), v[:1], np.arange(1), cells, 4)
    assert best == [[]]


def test_no_rows_and_too_large(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert V.top_k(df, query()).count() == 0
    with pytest.raises(OverflowError):
        V.top_k(spark.createDataFrame([(1, [3e15, 1.0])], "vec_id long, embedding array<double>"), query())
