"""Hard negatives by norm-bucketed search.

Each component becomes floor(SCALE * x). Rows are sorted by norm, the longest first, and cut into buckets of bounded size,
which go to the shared folder with their greatest norm. Anchors are dealt to tasks in blocks. A block reads buckets in
descending order of norm: a score is at most the anchor's norm times the bucket's greatest, so what lies below the least score
that can still count is never read. For positives that least score is the anchor's running kth; for negatives it is each
window's lower limit or, where that is higher, the window's running kth. Buckets that no anchor of the block needs end the
scan. Equal bounds are still read, so ties are exact.

Only anchors are shuffled, each to one task, and rows once, by norm. A task holds one bucket and one block of anchors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import bounded_batches, materialise, partitions, scratch, table
from docloom.llm.sorted_arrays import Store

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 50, 95
ANCHOR_STEP, NOISE_STEP, LABELS = 50, 7, 10
#: Rows of a bucket and bytes of its vectors, at most; anchors of a block.
BUCKET_ROWS, BUCKET_BYTES, BLOCK = 8192, 16 << 20, 512
#: Below this, products of floats are exact.
EXACT = 1 << 53
#: What is written down of a bucket, and in the other columns of an anchor.
_PART = "name string, d int, n long, square double, rid long, vec_id long, label long, v array<bigint>"


def whole(vectors: DataFrame, anchor: Column, label: Column, scale: int = SCALE) -> DataFrame:
    """(rid, vec_id, label, anchor, v array<bigint>, square) of the rows that take part; rid tells repeated rows apart.

    Left out are null ids, labels, vectors and components, components that aren't finite, and vectors without components.
    """
    x = F.col("embedding")
    ok = x.isNotNull() & F.col("vec_id").isNotNull() & label.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    kept = vectors.where(ok).select(F.col("vec_id").cast("long"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))
    rows = kept.withColumn("rid", F.monotonically_increasing_id())
    return rows.withColumn("square", F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e))


def _dimensions(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, vectors) of a batch."""
    col = b.column("v")
    sizes = np.diff(col.offsets.to_numpy())
    starts, flat = np.cumsum(sizes) - sizes, col.flatten().to_numpy()
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield d, at, flat[starts[at][:, None] + np.arange(d)]


def _write(store: Store):
    """Writes buckets; a row each, and one for each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush(d: int) -> pa.RecordBatch:
            v, rid, vec_id, label, square = (np.concatenate(x) for x in zip(*held.pop(d)))
            name, order = uuid.uuid4().hex, np.argsort(label, kind="stable")
            store.put(f"vectors-{name}", v[order])
            store.put(f"rows-{name}", np.stack([rid, vec_id, label])[:, order])
            return pa.RecordBatch.from_pylist([{"name": name, "d": d, "n": len(v), "square": float(square.max())}], kinds)

        kinds = pa.schema({"name": pa.string(), "d": pa.int32(), "n": pa.int64(), "square": pa.float64(), "rid": pa.int64(), "vec_id": pa.int64(), "label": pa.int64(), "v": pa.list_(pa.int64())})
        for b in batches:
            asks = b.filter(b.column("anchor"))
            if len(asks):
                lacks = {"name": None, "d": None, "n": None}
                yield pa.RecordBatch.from_arrays([pa.nulls(len(asks), kinds.field(c).type) if c in lacks else asks.column(c).cast(kinds.field(c).type) for c in kinds.names], schema=kinds)
            cols = [b.column(c).to_numpy() for c in ("rid", "vec_id", "label", "square")]
            for d, at, v in _dimensions(b):
                rows = max(1, min(BUCKET_ROWS, BUCKET_BYTES // 8 // d))
                for k in range(0, len(at), rows):
                    held.setdefault(d, []).append((v[k : k + rows], *(c[at[k : k + rows]] for c in cols)))
                    if sum(len(x[1]) for x in held[d]) >= rows:
                        yield flush(d)
        for d in list(held):
            yield flush(d)

    return run


class Best:
    """The k highest scores of each of n searches with the ids that they belong to, ties to the smaller id."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k, self.found = k, [[] for _ in range(n)]
        #: The least score that still counts.
        self.least = np.full(n, -np.inf) if floor is None else floor.astype(np.float64)

    def offer(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:  # those above the kth of these are enough, with those that equal it
            some = np.flatnonzero(scores >= np.partition(scores, -self.k)[-self.k])
            some = some[np.lexsort((ids[some], -scores[some]))[: self.k]]
            scores, ids = scores[some], ids[some]
        self.found[i] = sorted([*self.found[i], *zip((-scores).tolist(), ids.tolist())])[: self.k]
        if len(self.found[i]) == self.k:
            self.least[i] = max(self.least[i], -self.found[i][-1][0])


def search(anchors: np.ndarray, rid: np.ndarray, label: np.ndarray, buckets, k: int = POSITIVES, m: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> tuple[list, list, list[int]]:
    """(for each anchor its k best positives as (-score, id); for each of these its m best negatives likewise; buckets read for either).

    buckets() gives (greatest square, load) in descending order; load() gives vectors and (rid, vec_id, label), sorted by label.
    """
    norms = np.sqrt((anchors.astype(np.float64) ** 2).sum(1))
    reads = [0, 0]

    def needed(square: float, least: np.ndarray) -> np.ndarray:
        bound = norms * np.sqrt(square)
        return np.flatnonzero(bound + 1e-9 * bound + 1e-6 >= least)  # rounding never lowers a bound

    def scores(some: np.ndarray, v: np.ndarray, square: float) -> np.ndarray:
        if norms[some].max() * np.sqrt(square) < EXACT / 2:
            return (anchors[some].astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
        return anchors[some] @ v.T

    positives = Best(len(anchors), k)
    for square, load in buckets():
        some = needed(square, positives.least)
        if not len(some):
            break
        v, (rids, ids, labels) = load()
        reads[0] += 1
        some = some[np.argsort(label[some], kind="stable")]
        for kind in np.unique(label[some]).tolist():
            a, b = np.searchsorted(labels, [kind, kind + 1])
            own = some[label[some] == kind]
            if a == b:
                continue
            s = scores(own, v[a:b], square)
            hit = (s >= positives.least[own][:, None]) & (rids[a:b] != rid[own][:, None])
            for i in np.flatnonzero(hit.any(1)).tolist():
                at = np.flatnonzero(hit[i])
                positives.offer(int(own[i]), s[i, at], ids[a:b][at])
    owner = np.array([i for i, top in enumerate(positives.found) for _ in top], np.int64)
    score = np.array([-neg for top in positives.found for neg, _ in top], np.int64)
    floor, ceiling = -(-low * score // 100), high * score // 100
    windows = Best(len(owner), m, floor)
    windows.least[floor > ceiling] = np.inf
    first = np.searchsorted(owner, np.arange(len(anchors) + 1))
    for square, load in buckets():
        least = np.full(len(anchors), np.inf)
        np.minimum.at(least, owner, windows.least)
        some = needed(square, least)
        some = some[least[some] < np.inf]
        if not len(some):
            break
        v, (rids, ids, labels) = load()
        reads[1] += 1
        s = scores(some, v, square)
        other = labels != label[some][:, None]
        for i in np.flatnonzero((other & (s >= least[some][:, None])).any(1)).tolist():
            mine = other[i]
            for w in range(first[some[i]], first[some[i] + 1]):
                at = np.flatnonzero(mine & (s[i] >= windows.least[w]) & (s[i] <= ceiling[w]))
                if len(at):
                    windows.offer(w, s[i, at], ids[at])
    negatives = [windows.found[a:b] for a, b in zip(first[:-1], first[1:])]
    return positives.found, negatives, reads


def _mine(store: Store, k: int, m: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def buckets(d: int):
            def each():
                squares = store.read(f"squares-{d}", np.float64)
                names = store.read(f"names-{d}", "S32")
                for square, name in zip(squares, names):
                    name = name.decode()
                    yield float(square), lambda name=name: (store.read(f"vectors-{name}", np.int64).reshape(-1, d), store.read(f"rows-{name}", np.int64).reshape(3, -1))

            return each

        def flush(d: int, rows: int) -> Iterator[pa.RecordBatch]:
            v, rid, vec_id, label = (np.concatenate(x) for x in zip(*held.pop(d)))
            for a in range(0, len(v), rows):
                cut = slice(a, a + rows)
                positives, negatives, _ = search(v[cut], rid[cut], label[cut], buckets(d), k, m, low, high)
                found = [
                    (anchor, positive, rank, negative, -score, -below)
                    for anchor, top, tops in zip(vec_id[cut].tolist(), positives, negatives)
                    for (score, positive), window in zip(top, tops)
                    for rank, (below, negative) in enumerate(window, 1)
                ]
                cols = list(zip(*found)) or [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

        for b in batches:
            cols = [b.column(c).to_numpy() for c in ("rid", "vec_id", "label")]
            for d, at, v in _dimensions(b):
                held.setdefault(d, []).append((v, *(c[at] for c in cols)))
                if sum(len(x[1]) for x in held[d]) >= (rows := max(1, min(BLOCK, BUCKET_BYTES // 8 // d))):
                    yield from flush(d, rows)
        for d in list(held):
            yield from flush(d, max(1, min(BLOCK, BUCKET_BYTES // 8 // d)))

    return run


def mine(vectors: DataFrame, anchor: Column, label: Column, k: int = POSITIVES, m: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row where anchor holds and each of its k
    best rows of the same label, the m best rows of other labels whose score lies between low and high hundredths of the positive's.

    vectors holds (vec_id, embedding) and what anchor and label are made of; other columns take no part. Scores are integer inner
    products, ties go to the smaller vec_id. A vec_id that repeats is that many rows, as anchors, positives and negatives alike; only
    the anchor's own row is never its positive. Candidates of another dimensionality take no part, nor do rows that whole() leaves
    out. A negative positive score admits nothing, as its window is empty. An empty table gives no rows. Scores that could leave 63
    bits are refused.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = whole(vectors, anchor, label, scale)
    longest = rows.agg(F.max("square")).first()[0]
    if longest is not None and longest * 100 >= 1 << 62:
        raise OverflowError("scores could leave 63 bits")
    store = Store(f"{scratch(spark)}/docloom-negatives-{uuid.uuid4().hex}")
    ordered = rows.repartitionByRange(partitions(spark), F.col("square").desc(), "rid").sortWithinPartitions(F.col("square").desc(), "rid")
    # names are drawn anew when a task is repeated, so they are written down before anything is read by them
    parts = materialise(ordered.mapInArrow(_write(store), _PART), "negatives")
    buckets, anchors = parts.where(F.col("name").isNotNull()), parts.where(F.col("name").isNull())
    listing: dict[int, list] = {}
    for r in buckets.select("d", "square", "name").orderBy("d", F.desc("square"), "name").collect():  # a row per BUCKET_ROWS vectors
        listing.setdefault(r.d, []).append((r.square, r.name))
    for d, some in listing.items():
        store.put(f"squares-{d}", np.array([s for s, _ in some]))
        store.put(f"names-{d}", np.array([n for _, n in some], "S32"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-anchors.count() // (8 * BLOCK)))
    found = anchors.select("rid", "vec_id", "label", "v").repartition(tasks, "rid").mapInArrow(_mine(store, k, m, low, high), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return found


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows whose vec_id is divisible by 50; every seventh label is first moved on by one."""
    given = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % NOISE_STEP == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return mine(given, F.col("vec_id") % ANCHOR_STEP == 0, label)


ORACLE = f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, (CASE WHEN vec_id % {NOISE_STEP} = 0 THEN (label + 1) % {LABELS} ELSE label END)::BIGINT AS label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.rid, a.vec_id AS anchor_id, c.rid AS other, c.vec_id, a.label = c.label AS same, list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM e a JOIN e c ON a.rid <> c.rid AND len(a.v) = len(c.v) WHERE a.vec_id % {ANCHOR_STEP} = 0),
p AS (SELECT rid, anchor_id, other, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS k FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.rid, p.other ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM p JOIN s ON p.rid = s.rid AND NOT s.same AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score WHERE p.k <= {POSITIVES})
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
