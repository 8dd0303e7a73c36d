"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are words and word beginnings, all of them, told apart by 63-bit hashes. The examples are a bounded sample of labelled
documents; their terms are the vocabulary, and document frequencies are counted over all documents. Every document becomes
the TF-IDF vector of its whole text, in which terms that tell the labels of the examples apart (chi-squared and lift) weigh
GAIN times as much. Examples form an inverted index. Long posting lists are cut into blocks of examples with the largest
weight of each term per block: what they add to an example is bounded by its block's maxima, and examples are scored in the
order of their bounds until no bound reaches the k-th cosine, so neighbours are exact, and every text that shares any term
with an example has some. Distance-weighted votes of the neighbours are calibrated on the votes that each example gets from
the others.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import Shared, bounded_batches, discard, fold, materialise, table

#: Bound of the index: labelled documents in it.
MAX_EXAMPLES = 4_000
NEIGHBOURS, BLOCK, SOFT = 15, 64, 0.05
#: A term tells the labels apart if its chi-squared statistic and its lift are so high; its weight is then GAIN times its TF-IDF.
CHI2, LIFT, GAIN = 25.0, 3.0, 30.0
PREFIX = 4
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: A list is long if it holds more than this share of the examples. So many examples are scored between two looks at the bounds.
FREQUENT, FIRST = 1 / 4, 64
_SPACES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def many_terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted hashes, then a row for each text and term of it, in order: number of the text, number of the hash, count) of the lower-case words of texts and of the beginnings, PREFIX bytes, of longer words."""
    ids: dict[bytes, int] = defaultdict(itertools.count().__next__)
    words = [(t or "").lower().encode("utf-8", "replace").translate(_SPACES).split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    at = np.fromiter(map(ids.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(sizes.sum()))
    whole = np.fromiter((xxhash.xxh64_intdigest(w, 1) >> 1 for w in ids), np.int64, len(ids))
    begin = np.fromiter((xxhash.xxh64_intdigest(w[:PREFIX], 2) >> 1 if len(w) > PREFIX else -1 for w in ids), np.int64, len(ids))
    long = begin >= 0
    hashes, code = np.unique(np.r_[whole, begin[long]], return_inverse=True)
    begin[long] = code[len(whole) :]
    doc = np.repeat(np.arange(len(texts)), sizes) << 32
    begins = begin[at]
    rows, n = np.unique(np.r_[doc | code[: len(whole)][at], (doc | begins)[begins >= 0]], return_counts=True)
    return hashes, rows >> 32, rows & 0xFFFFFFFF, n


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of one text's terms."""
    hashes, _, at, n = many_terms([text])
    return hashes[at], n


def _stretches(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)


def _sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(z, np.float64)))


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def calibration(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(scale, shift) of the logistic curve that fits labels to the log-odds of votes, with softened targets; damped Newton steps. (1, 0) if labels are alike or votes tell nothing."""
    if len(set(labels.tolist())) < 2:
        return 1.0, 0.0
    x, y = _logit(votes), labels
    y = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    at = np.array([1.0, 0.0])

    def loss(v):
        z = v[0] * x + v[1]
        return np.logaddexp(0, z).sum() - (y * z).sum() + 5e-4 * ((v[0] - 1) ** 2 + v[1] ** 2)

    for _ in range(100):
        p = _sigmoid(at[0] * x + at[1])
        g = np.array([((p - y) * x).sum() + 1e-3 * (at[0] - 1), (p - y).sum() + 1e-3 * at[1]])
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        while loss(at - step) > loss(at) + 1e-12 and np.abs(step).max() > 1e-10:
            step /= 2
        at = at - step
        if np.abs(step).max() < 1e-9:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


class Index:
    """Block-max inverted index of labelled TF-IDF vectors, with calibrated votes."""

    def __init__(self, vocabulary: np.ndarray, idf: np.ndarray, gain: np.ndarray):
        """vocabulary: sorted hashes; idf and gain: of each term."""
        self.vocabulary, self.idf, self.weight = vocabulary, idf, idf * gain
        self.scale, self.shift, self.empty = 1.0, 0.0, 0.0

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each hash in the vocabulary, -1 if it isn't there."""
        at = np.searchsorted(self.vocabulary, hashes)
        hit = at < len(self.vocabulary)
        hit[hit] = self.vocabulary[at[hit]] == hashes[hit]
        return np.where(hit, at, -1)

    def vectors(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(term numbers, weights of length 1) of each whole text; terms that no example has take no part."""
        hashes, doc, code, n = many_terms(texts)
        at = self.known(hashes)[code]
        hit = at >= 0
        doc, at, x = doc[hit], at[hit], (1 + np.log(n[hit])) * self.weight[at[hit]]
        edge = np.searchsorted(doc, np.arange(len(texts) + 1))
        for a, b in zip(edge[:-1], edge[1:]):
            yield at[a:b], x[a:b] / (np.linalg.norm(x[a:b]) or 1.0)

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return next(self.vectors([text]))

    def build(self, examples: list[tuple[int, int, np.ndarray, np.ndarray]]) -> None:
        """examples: (doc_id, label, term numbers, weights). Those without terms only set the score of empty vectors."""
        bare = [y for _, y, at, _ in examples if not len(at)]
        self.empty = (sum(bare) + 0.5) / (len(bare) + 50.0)
        # like examples side by side make tight blocks: by the heaviest term
        full = self.examples = sorted((e for e in examples if len(e[2])), key=lambda e: (int(e[2][e[3].argmax()]), e[0]))
        self.ids, self.labels = np.array([e[0] for e in full], np.int64), np.array([e[1] for e in full], np.float64)
        doc = np.repeat(np.arange(len(full), dtype=np.int32), [len(e[2]) for e in full])
        term = np.concatenate([e[2] for e in full]) if full else np.zeros(0, np.int64)
        weight = np.concatenate([e[3] for e in full]) if full else np.zeros(0)
        n = np.bincount(term, minlength=len(self.vocabulary))
        often = np.flatnonzero(n > max(BLOCK, FREQUENT * len(full)))
        self.often = np.full(len(self.vocabulary), -1, np.int64)
        self.often[often] = np.arange(len(often))
        long = self.often[term] >= 0
        # long lists: block by block, with the largest weight of each term in each block
        self.blocks = -(-len(full) // BLOCK)
        self.lists = np.zeros((self.blocks * BLOCK, len(often)))
        self.lists[doc[long], self.often[term[long]]] = weight[long]
        self.maxima = self.lists.reshape(self.blocks, BLOCK, len(often)).max(axis=1)
        self.norms = np.linalg.norm(self.lists, axis=1)[: len(full)]
        # short lists, a stretch for each term
        order = np.lexsort((doc[~long], term[~long]))
        self.docs, self.weights = doc[~long][order], weight[~long][order]
        self.start = np.searchsorted(term[~long][order], np.arange(len(self.vocabulary) + 1))

    def nearest(self, at: np.ndarray, x: np.ndarray, k: int = NEIGHBOURS, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of the k nearest examples with a term in common, ties to the smaller doc_id; row but is left out.

        Short lists are scored in full. What the long ones can add to an example is bounded by its block's maxima, and by the
        lengths of both vectors there; examples are scored in the order of their bounds until none reaches the k-th cosine.
        """
        if not len(self.ids):
            return np.zeros(0, np.int64), np.zeros(0)
        low, size = self.start[at], self.start[at + 1] - self.start[at]
        posting = _stretches(low, size)
        partial = np.bincount(self.docs[posting], self.weights[posting] * np.repeat(x, size), len(self.ids))
        often = self.often[at]
        some = often >= 0
        cols, rest = often[some], x[some]
        by_block = np.repeat(self.maxima[:, cols] @ rest, BLOCK)[: len(self.ids)]
        bound = partial + np.minimum(by_block, self.norms * np.linalg.norm(rest)) + 1e-9
        bound[(by_block == 0) & (partial == 0)] = 0
        if but >= 0:
            bound[but] = 0
        whole = np.zeros(self.lists.shape[1])
        whole[cols] = rest
        rows, cosines, least, step = np.zeros(0, np.int64), np.zeros(0), 0.0, FIRST
        while True:
            live = np.flatnonzero((bound > 0) & (bound >= least))
            if not len(live):
                return rows, cosines
            if len(live) > step:
                live = live[np.argpartition(-bound[live], step - 1)[:step]]
            score = np.round(partial[live] + self.lists[live] @ whole, 12)
            bound[live] = 0  # done
            if len(live) > k:  # those that tie with the k-th stay
                keep = score >= np.partition(score, len(live) - k)[len(live) - k]
                live, score = live[keep], score[keep]
            rows, cosines = np.concatenate([rows, live[score > 0]]), np.concatenate([cosines, score[score > 0]])
            top = np.lexsort((self.ids[rows], -cosines))[:k]
            rows, cosines = rows[top], cosines[top]
            least, step = cosines[-1] if len(rows) == k else 0.0, step * 8

    def vote(self, rows: np.ndarray, cosines: np.ndarray) -> float:
        w = 1 / (SOFT + 1 - np.minimum(cosines, 1))
        return float((w @ self.labels[rows] + self.empty) / (w.sum() + 1))

    def left_out(self, row: int) -> float:
        """The vote that an example gets from the others."""
        return self.vote(*self.nearest(self.examples[row][2], self.examples[row][3], but=row))

    def score(self, text: str | None) -> tuple[float, list[tuple[int, float, int]]]:
        """(score, evidence): evidence holds (doc_id, cosine, label) of the nearest examples."""
        return self.score_vector(*self.vector(text))

    def score_vector(self, at: np.ndarray, x: np.ndarray) -> tuple[float, list[tuple[int, float, int]]]:
        rows, cosines = self.nearest(at, x)
        if not len(rows):
            return self.empty, []
        p = _sigmoid(self.scale * _logit(self.vote(rows, cosines)) + self.shift)
        return float(p), [(int(self.ids[r]), float(c), int(self.labels[r])) for r, c in zip(rows, cosines)]


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [terms(t) for t in b.column("text").to_pylist()]  # few rows
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("label"), *(pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (0, 1))], ["doc_id", "label", "terms", "n"]
        )


def _document_frequencies(vocabulary: Shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = vocabulary.value()
        n = np.zeros(len(index.vocabulary), np.int64)
        for b in batches:
            hashes, _, code, _ = many_terms(b.column("text").to_pylist())
            at = index.known(hashes)
            n[at[at >= 0]] += np.bincount(code, minlength=len(hashes))[at >= 0]
        some = np.flatnonzero(n)
        for k in range(0, len(some), 1 << 18):
            part = some[k : k + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(n[part])], ["term", "n"])

    return run


def train(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Index:
    """An index of labelled rows of docs: max_examples of labels (doc_id, toxic) at most, those whose hash of doc_id is lowest.

    Rows without id or label are no examples; of several labels of an id the highest counts; of repeated ids of docs each
    row is an example. Document frequencies are those of all rows of docs.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    one = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    chosen = one.orderBy(F.xxhash64("doc_id", F.lit("toxicity")), "doc_id").limit(max_examples)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long"), "label", "text")
    rows = materialise(rows.mapInArrow(_example_terms, "doc_id long, label int, terms array<long>, n array<long>"), "examples")
    got = rows.toArrow()  # max_examples rows, unless ids repeat
    discard(rows)
    ids, label = got.column("doc_id").to_numpy(), got.column("label").to_numpy()
    keys, counts = ([x.values.to_numpy() for x in got.column(c)] for c in ("terms", "n"))
    every = np.concatenate([*keys, np.zeros(0, np.int64)])
    vocabulary, back = np.unique(every, return_inverse=True)
    n = np.bincount(back, minlength=len(vocabulary)).astype(np.float64)
    bad = np.bincount(back, np.repeat(label, [len(k) for k in keys]), len(vocabulary)) if len(every) else np.zeros(0)
    total, n_bad = float(len(ids)), float(label.sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = total * (bad * total - n * n_bad) ** 2 / (n * n_bad * (total - n) * (total - n_bad))
        lift = ((bad + 0.5) / (n + 1)) / ((n_bad + 0.5) / (total + 1))
    telling = (chi2 >= min(CHI2, 0.25 * total)) & ((lift >= LIFT) | (lift <= 1 / LIFT))
    df = np.zeros(len(vocabulary), np.int64)
    bare = Shared(spark, Index(vocabulary, np.ones(0), np.ones(0)))
    counted = docs.select("text").mapInArrow(_document_frequencies(bare), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    idf = np.log((1 + docs.count()) / (1 + df)) + 1
    index = Index(vocabulary, idf, np.where(telling, GAIN, 1.0))
    examples, at = [], 0
    for d, y, k, c in zip(ids.tolist(), label.tolist(), keys, counts):
        where = back[at : at + len(k)]
        at += len(k)
        x = (1 + np.log(c)) * index.weight[where]
        examples.append((d, y, where, x / (np.linalg.norm(x) or 1.0)))
    index.build(sorted(examples, key=lambda e: (e[0], e[1], e[2].tobytes(), e[3].tobytes())))
    if len(index.examples):
        shared, numbers = Shared(spark, index), spark.range(0, len(index.examples), 1, 24)

        def leave_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value()
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([m.left_out(k) for k in b.column("id").to_pylist()], pa.float64())], ["id", "vote"])

        votes = numbers.mapInArrow(leave_out, "id long, vote double").toArrow().sort_by("id").column("vote").to_numpy()
        index.scale, index.shift = calibration(votes, index.labels)
    index.examples = []
    return index


def score(docs: DataFrame, index: Index) -> DataFrame:
    """docs with score (calibrated probability) and evidence (doc_id, cosine, label of the nearest examples).

    A null or empty text, like any that shares no term with an example, has the score of such examples and no evidence. Very
    long texts count whole. Columns of docs named score or evidence are replaced; repeated rows are scored each; an empty
    table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    cols = [c for c in docs.columns if c not in ("score", "evidence")]
    shared = Shared(docs.sparkSession, index)  # MAX_EXAMPLES sparse rows at most
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value()
        for b in batches:
            texts = b.column("text").to_pylist()
            distinct = list(dict.fromkeys(texts))  # equal texts are looked up once a batch
            found = {t: m.score_vector(at, x) for t, (at, x) in zip(distinct, m.vectors(distinct))}
            out = [found[t] for t in texts]
            evidence = [[{"doc_id": d, "cosine": c, "label": y} for d, c, y in o[1]] for o in out]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array([o[0] for o in out], pa.float64()), pa.array(evidence, kind)], [*cols, "score", "evidence"])

    proof = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("label", T.IntegerType())]))
    schema = T.StructType([*(docs.schema[c] for c in cols), T.StructField("score", T.DoubleType()), T.StructField("evidence", proof)])
    return docs.select(*cols).mapInArrow(run, schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", FOLDS) != HELD_OUT)
    found = score(docs, train(docs, labels))
    return found.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
