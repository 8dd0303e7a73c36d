"""Language ID: multinomial logistic regression on TF-IDF character n-grams.

N-grams of 1 to 3 characters are hashed to DIM features, whose document frequencies are counted over all documents that
may be learnt from. The model is trained by follow-the-regularised-leader with elastic-net penalties, which leave most
weights at exactly 0, on a bounded sample: PER_LANG documents of each language at most. Its softmax is then calibrated by
one temperature, found by Newton's method on a fifth of the sample that training never sees. The weights (DIM x languages)
are the only thing that is broadcast; every document is scored on its whole text where it lies.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import Shared, bounded_batches, fold, table, trimmed

UNKNOWN = "und"
DIM_BITS = 14
#: Bound of the training sample: documents per language. A table that names more languages than MAX_LANGS is refused.
PER_LANG, MAX_LANGS = 700, 5_000
FOLDS, HELD_OUT = 5, 0
#: Follow-the-regularised-leader: learning rate, its offset, the two penalties, passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.3, 1e-3, 3
_K = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


@functools.cache
def _kinds() -> np.ndarray:
    """Of each code point: 2 for a letter, 1 for a mark that goes with letters, else 0."""
    of = {"L": 2, "M": 1}
    return np.fromiter((of.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)


def letters(text: str) -> np.ndarray:
    """Lower-cased code points of letters and their marks; runs of other characters are one space. Empty without a letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _kinds()[c]
    if not (kind == 2).any():
        return c[:0]
    c = np.where(kind > 0, c, 32).astype(np.uint32)
    return c[(c != 32) | np.r_[True, c[:-1] != 32]]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, damped counts) of a text's n-grams; none if it has no letters."""
    c = letters(text or "")
    if not len(c):
        return np.zeros(0, np.int64), np.zeros(0)
    one = c * _K[0]
    grams = [one[c != 32] ^ np.uint32(1)]
    if len(c) > 1:
        two = (one[:-1] ^ (c[1:] * _K[1])) * _K[2]
        grams.append(two ^ np.uint32(2))
        if len(c) > 2:
            grams.append((two[:-1] ^ (c[2:] * _K[0])) * _K[1])
    h = np.concatenate(grams)
    h = (h ^ (h >> np.uint32(15))) * _K[1]
    n = np.bincount(h >> np.uint32(32 - DIM_BITS), minlength=1 << DIM_BITS)
    at = np.flatnonzero(n)
    return at, 1 + np.log(n[at])


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        x = tf * self.idf[at]
        return x / (np.linalg.norm(x) or 1.0)

    def logits(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return self.vector(at, tf) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        at, tf = features(text)
        if not len(at) or not self.langs:
            return UNKNOWN, 0.0
        p = _softmax(self.logits(at, tf) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least loss against targets of 1 - 1 / (rows + 2), the rest of 1 spread over the other languages.

    The loss is convex in 1 / temperature; such targets keep its least value finite even where every row is right.
    """
    n, k = logits.shape
    target = np.full((n, k), 1 / (n + 2) / (k - 1))
    target[np.arange(n), truth] = 1 - 1 / (n + 2)
    z = logits - logits.mean(axis=1, keepdims=True)
    loss = lambda b: -(target * (b * z - b * z.max(axis=1, keepdims=True) - np.log(np.exp(b * (z - z.max(axis=1, keepdims=True))).sum(axis=1, keepdims=True)))).sum()
    b = 1.0
    for _ in range(100):
        p = _softmax(b * z)
        mean = (p * z).sum(axis=1, keepdims=True)
        slope, bend = ((p - target) * z).sum(), (p * (z - mean) ** 2).sum()
        step = slope / max(bend, 1e-12)
        step = float(np.clip(step, -2 * b, 0.75 * b))  # stays positive
        while loss(b - step) > loss(b) + 1e-12 and abs(step) > 1e-9:
            step /= 2
        b -= step
        if abs(step) < 1e-8 * b:
            break
    return 1 / b


def fit(examples: list[tuple[str, np.ndarray, np.ndarray]], df: np.ndarray | None = None, n_docs: int = 0) -> Model:
    """A model of (language, feature numbers, damped counts) rows; df counts the n_docs documents with each feature (default: those of the rows). Every fifth row sets the temperature only."""
    langs = sorted({e[0] for e in examples})
    dim = 1 << DIM_BITS
    if df is None:
        df, n_docs = np.zeros(dim), len(examples)
        for _, at, _ in examples:
            df[at] += 1
    model = Model(langs, np.log((1 + n_docs) / (1 + df)) + 1, np.zeros((dim, len(langs))), np.zeros(len(langs)))
    if len(langs) < 2:
        return model
    code = {v: k for k, v in enumerate(langs)}
    rows = [(code[y], at, model.vector(at, tf)) for y, at, tf in examples]
    train, aside = [r for k, r in enumerate(rows) if k % 5], [r for k, r in enumerate(rows) if not k % 5]
    z, n = np.zeros_like(model.weights), np.zeros_like(model.weights)
    zb, nb = np.zeros(len(langs)), np.zeros(len(langs))
    draw = np.random.default_rng(7)

    def leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    for _ in range(EPOCHS):
        for k in draw.permutation(len(train)):
            y, at, x = train[k]
            w, bias = leader(z[at], n[at]), -zb / ((BETA + np.sqrt(nb)) / ALPHA + L2)
            error = _softmax(x @ w + bias)
            error[y] -= 1
            g = x[:, None] * error
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
            more = nb + error * error
            zb += error - (np.sqrt(more) - np.sqrt(nb)) / ALPHA * bias
            nb = more
    model.weights, model.bias = leader(z, n), -zb / ((BETA + np.sqrt(nb)) / ALPHA + L2)
    model.temperature = _temperature(np.array([x @ model.weights[at] + model.bias for _, at, x in aside]), np.array([y for y, _, _ in aside]))
    return model


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a task: its documents, and how many have each feature."""
    df, n = np.zeros(1 << DIM_BITS, np.int64), 0
    for b in batches:
        for t in b.column("text").to_pylist():
            df[features(t)[0]] += 1
            n += 1
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([df.tobytes()], pa.binary())], ["n", "df"])


def _add_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(1 << DIM_BITS, np.int64), 0
    for b in batches:
        for x in b.column("df").to_pylist():
            df += np.frombuffer(x, np.int64)
        n += sum(b.column("n").to_pylist())
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([df.tobytes()], pa.binary())], ["n", "df"])


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [features(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array([r[0].tolist() for r in rows], pa.list_(pa.int32())), pa.array([r[1].astype(np.float32) for r in rows], pa.list_(pa.float32()))], ["lang", "at", "tf"])


def train(docs: DataFrame, lang: str = "lang", per_lang: int = PER_LANG) -> Model:
    """A model of docs (doc_id, text and a column of languages).

    The sample is fixed by the rows: of each language the per_lang whose hash of doc_id and text is least. Rows without
    text or language aren't learnt from; texts without letters are no examples.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    u = F.pmod(F.xxhash64("doc_id", "text", F.lit("language")), F.lit(1 << 40))
    rows = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull()).select(F.col(lang).alias("lang"), "text", u.alias("u"))
    counts = rows.groupBy("lang").count().orderBy("lang").limit(MAX_LANGS + 1).collect()
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not counts:
        return Model([], np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    # twice the share that gives per_lang rows is looked at, then ranked: the window never sees a whole language
    # an Arrow table: rows of Python objects would start a second set of workers on every executor
    most = [int(min(1.0, 2 * per_lang / r[1] + 60 / r[1]) * (1 << 40)) for r in counts]
    share = spark.createDataFrame(pa.table({"l": pa.array([r[0] for r in counts], pa.string()), "most": pa.array(most, pa.int64())}))
    few = rows.join(F.broadcast(share), F.col("lang") == F.col("l")).where(F.col("u") < F.col("most"))
    first = F.row_number().over(W.partitionBy("lang").orderBy("u"))
    sample = few.withColumn("rank", first).where(F.col("rank") <= per_lang).select("lang", "text")
    got = sample.mapInArrow(trimmed(_featurise), "lang string, at array<int>, tf array<float>").toArrow()  # per_lang rows of each language at most
    examples = []
    for b in got.to_batches():
        for y, at, tf in zip(b.column("lang").to_pylist(), b.column("at"), b.column("tf")):
            if len(at.values):
                examples.append((y, at.values.to_numpy().astype(np.int64), tf.values.to_numpy().astype(np.float64)))
    examples.sort(key=lambda e: (e[0], len(e[1]), e[1].tobytes(), e[2].tobytes()))  # the order of partitions doesn't matter
    order = np.random.default_rng(11).permutation(len(examples))
    # sums of the tasks' counts (a row each) are added in groups, then here
    parts = rows.select("text").mapInArrow(trimmed(_count_features), "n long, df binary").repartition(32).mapInArrow(trimmed(_add_features), "n long, df binary").collect()
    df = sum((np.frombuffer(bytes(p.df), np.int64) for p in parts), np.zeros(1 << DIM_BITS, np.int64))
    return fit([examples[k] for k in order], df, sum(p.n for p in parts))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score.

    A null text, or one without letters (Unicode category L), gets "und" with score 0; so does every text if the model knows
    no language. Of languages with equal scores the first by name is taken. Very long texts count whole. Columns of docs
    with those names are replaced; repeated rows are scored each; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    cols = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = Shared(docs.sparkSession, model)  # DIM x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value()
        for b in batches:
            out = [m.predict(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], [*cols, "lang_pred", "score"])

    schema = T.StructType([*(docs.schema[c] for c in cols), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*cols).mapInArrow(trimmed(run), schema)


def learnt_rows(docs: DataFrame) -> DataFrame:
    return docs.where(fold("doc_id", FOLDS) != HELD_OUT)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text."""
    docs = table(spark, sf_dir, "documents")
    model = train(learnt_rows(docs.select("doc_id", "text", "lang")))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
