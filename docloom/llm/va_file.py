"""Exact top-k inner-product search with vector-approximation files.

Each component becomes floor(SCALE * x). Every dimension is cut into CELLS equal cells between its extremes in the table; a
vector's approximation is one byte per dimension. The table is written once to the shared folder in parts of bounded size:
a file of approximations and a file of exact vectors, row by row alike; queries are written in blocks beside them.

For a query and a row's cells, one product gives an upper bound of the score (a lower bound of the distance that it
stands for). A task scans the approximations of its part against one block of queries after the other, and reads exact
vectors of the other file in bound order until the k-th best score so far is above every bound that is left; equal bounds
are still read, so ties are exact. Each task returns its own best k per query, and the k best of those remain. Nothing but
the names of parts and blocks goes through the driver or a broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import bounded_batches, materialise, scratch, table
from docloom.llm.sorted_arrays import Store

SCALE, TOP, QUERY_STEP = 1024, 10, 100
CELLS = 64
#: Rows of a part and bytes of its exact vectors, at most; bytes of the bounds of one step of a scan.
PART_ROWS, PART_BYTES, BOUND_BYTES = 16_384, 32 << 20, 16 << 20
READ = 64


def whole(vectors: DataFrame, query: Column, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<bigint>, query) of the vectors that take part: no null id, vector or component, nothing non-finite, not empty."""
    x = F.col("embedding")
    ok = x.isNotNull() & F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.where(ok).select(F.col("vec_id").cast("long"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"), F.coalesce(query, F.lit(False)).alias("query"))


class Approximation:
    """Cells of one dimensionality."""

    def __init__(self, low: np.ndarray, high: np.ndarray, cells: int = CELLS):
        self.low, self.width = low, np.maximum(1, -((low - high - 1) // cells))

    def encode(self, v: np.ndarray) -> np.ndarray:
        return ((v - self.low) // self.width).astype(np.uint8)

    def bounds(self, codes: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Upper bounds (query by row) of the scores of rows by their cells: the cells' corners, by one product, and the widths."""
        q = queries.astype(np.float64)
        rest = q @ self.low + np.maximum(q, 0) @ (self.width - 1)
        at = (q * self.width) @ codes.T.astype(np.float64)
        slack = 1e-9 * (np.abs(q) @ (np.abs(self.low) + CELLS * self.width)) + 1e-6  # rounding never lowers a bound
        return at + (rest + slack)[:, None]


def search(queries: np.ndarray, own: np.ndarray, codes: np.ndarray, exact: np.ndarray, vec_ids: np.ndarray, cells: Approximation, k: int) -> tuple[list[list[tuple[int, int]]], int]:
    """(for each query up to k of (-score, vec_id), sorted; exact vectors read). own: the query's own row among these, or -1."""
    best: list[list[tuple[int, int]]] = []
    read, step = 0, max(1, BOUND_BYTES // 8 // max(1, len(codes)))
    for first in range(0, len(queries), step):
        upper = cells.bounds(codes, queries[first : first + step])
        for i, bound in enumerate(upper, first):
            if own[i] >= 0:
                bound[own[i]] = -np.inf
            top, limit, take = [], -np.finfo(np.float64).max, READ
            while len(rows := np.flatnonzero(bound >= limit)):
                if len(rows) > take:  # those of the highest bounds first
                    rows = np.sort(rows[np.argpartition(-bound[rows], take - 1)[:take]])
                score, ids = exact[rows].astype(np.int64) @ queries[i], vec_ids[rows]
                some = np.lexsort((ids, -score))[:k]
                top = sorted([*top, *zip((-score[some]).tolist(), ids[some].tolist())])[:k]
                limit = -top[-1][0] if len(top) == k else limit
                bound[rows] = -np.inf
                read, take = read + len(rows), take * 2
            best.append(top)
    return best, read


def _write(store: Store, extremes: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Writes parts; a row each: (name, dimension, rows, queries)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush(d: int) -> pa.RecordBatch:
            v, ids, query = (np.concatenate(x) for x in zip(*held.pop(d)))
            name, cells = uuid.uuid4().hex, Approximation(*extremes[d])
            store.put(f"codes-{name}", cells.encode(v))
            store.put(f"exact-{name}", v)
            store.put(f"ids-{name}", ids)
            at = np.flatnonzero(query)
            store.put(f"rows-{name}", at)
            store.put(f"query-{name}", v[at])
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([d], pa.int32()), pa.array([len(v)], pa.int64()), pa.array([len(at)], pa.int64())], ["name", "d", "n", "queries"])

        for b in batches:
            col = b.column("v")
            sizes = np.diff(col.offsets.to_numpy())
            flat, ids, query = col.flatten().to_numpy(), b.column("vec_id").to_numpy(), b.column("query").to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for d in np.unique(sizes).tolist():
                rows = max(1, min(PART_ROWS, PART_BYTES // 8 // d))
                at = np.flatnonzero(sizes == d)
                for k in range(0, len(at), rows):
                    some = at[k : k + rows]
                    held.setdefault(d, []).append((flat[starts[some][:, None] + np.arange(d)], ids[some], query[some]))
                    if sum(len(x[1]) for x in held[d]) >= rows:
                        yield flush(d)
        for d in list(held):
            yield flush(d)

    return run


def _scan(store: Store, extremes: dict, blocks, k: int):
    """(query, query_id, vec_id, score): the best k of each part for each query. query names the query's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, d in zip(b.column("name").to_pylist(), b.column("d").to_pylist()):
                cells, ids = Approximation(*extremes[d]), store.read(f"ids-{name}", np.int64)
                codes, exact = (store.read(f"{what}-{name}", kind).reshape(-1, d) for what, kind in (("codes", np.uint8), ("exact", np.int64)))
                for block in blocks.value.get(d, ()):
                    rows = store.read(f"rows-{block}", np.int64)
                    asked = store.read(f"query-{block}", np.int64).reshape(-1, d)
                    own = rows if block == name else np.full(len(rows), -1)
                    best, _ = search(asked, own, codes, exact, ids, cells, k)
                    number = store.read(f"ids-{block}", np.int64)[rows]
                    found = [(f"{block}-{r}", int(q), vec, -neg) for r, q, top in zip(rows.tolist(), number.tolist(), best) for neg, vec in top]
                    for at in range(0, len(found), 10_000):
                        cols = list(zip(*found[at : at + 10_000]))
                        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["query", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, query: Column, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest integer inner products over vectors of each row where query holds, ties to smaller vec_id.

    vectors holds (vec_id, embedding); other columns, whatever their names, take no part. A query's candidates are all rows
    but its own; a vec_id that repeats is that many rows, queries and candidates alike. Candidates of another dimensionality
    take no part, nor do vectors that whole() leaves out. An empty table gives no rows. Scores that could leave 63 bits are
    refused.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = whole(vectors, query)
    ranges = rows.select(F.size("v").alias("d"), F.posexplode("v").alias("at", "x")).groupBy("d", "at").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    sides: dict[int, list] = {}
    for r in ranges.orderBy("d", "at").collect():  # one row per dimension
        sides.setdefault(r.d, []).append((r.low, r.high))
    extremes = {d: tuple(np.array(x, np.int64).T) for d, x in sides.items()}
    for low, high in extremes.values():
        if sum(max(abs(int(a)), abs(int(b))) ** 2 for a, b in zip(low, high)) >= 1 << 62:
            raise OverflowError("scores could leave 63 bits")
    store = Store(f"{scratch(spark)}/docloom-va-{uuid.uuid4().hex}")
    # names are drawn anew when a task is repeated, so they are written down before anything is read by them
    parts = materialise(rows.mapInArrow(_write(store, extremes), "name string, d int, n long, queries long"), "va")
    blocks: dict[int, list[str]] = {}
    for r in parts.where("queries > 0").select("name", "d").collect():  # a row per PART_ROWS vectors
        blocks.setdefault(r.d, []).append(r.name)
    scan = _scan(store, extremes, spark.sparkContext.broadcast(blocks), k)
    found = parts.repartition(spark.sparkContext.defaultParallelism * 4, "name").mapInArrow(scan, "query string, query_id long, vec_id long, score long")
    order = W.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of every row for each row whose vec_id is divisible by 100."""
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % QUERY_STEP == 0)


ORACLE = f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM e q JOIN e c ON q.rid <> c.rid AND len(q.v) = len(c.v) WHERE q.vec_id % {QUERY_STEP} = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}
"""
