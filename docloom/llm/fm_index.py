"""Benchmark decontamination with one FM-index per training shard.

A shard is a run of whole documents of one scan partition, about SHARD_WORDS words. Its words become integers (one
dictionary per shard, every word kept), each document ends in a sentinel of its own, and the suffix array, the
Burrows-Wheeler transform, a wavelet matrix with rank directories and sampled suffix positions are built over them.
Windows of the benchmark are searched backwards, all at once; the matching rows are walked to a sampled position.
Occurrences become word spans, which are merged per document. Documents never leave their scan task: no shuffle.

The windows travel as broadcasts of at most PASS_WINDOWS windows. A larger benchmark takes more passes over the same
task, each merging its spans into those of the last, so nothing is left out. The passes of a task, and the cutting after
them, run in one Python worker.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import bounded_batches, table, trimmed

WINDOW = 10
SHARD_WORDS = 1 << 20
PASS_WINDOWS = 200_000
SAMPLE = 8
#: A-Z to a-z; every ASCII byte but letters and digits to a space; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix order of integers >= 0 by prefix doubling; settled suffixes leave the later rounds."""
    n = len(seq)
    if not n:
        return np.zeros(0, np.int64)
    bits, wide = int(n).bit_length(), int(seq.max() + 1).bit_length()
    if 2 * wide + bits <= 63:  # the first two symbols at once
        pair = (seq + 1) << wide
        pair[:-1] |= seq[1:] + 1
        packed = np.sort(pair << bits | np.arange(n))
        sa, key, h = packed & ((1 << bits) - 1), packed >> bits, 2
    else:
        sa = np.argsort(seq, kind="stable")
        key, h = seq[sa], 1
    first = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], np.arange(n), 0))
    rank = np.zeros(n + 1, np.int64)  # 0: past the end
    rank[sa] = first + 1
    open_slots = np.arange(n)
    while True:
        # a slot is open while its group of equal prefixes has other members
        r = rank[sa[open_slots]]
        same = r[1:] == r[:-1]
        keep = np.r_[same, False] | np.r_[False, same]
        open_slots = open_slots[keep]
        if not len(open_slots):
            return sa
        pos = sa[open_slots]
        second = rank[np.minimum(pos + h, n)]
        if 3 * bits <= 63:
            packed = np.sort((rank[pos] << (2 * bits)) | (second << bits) | pos)
            pos, pair = packed & ((1 << bits) - 1), packed >> bits
            fresh = np.r_[True, pair[1:] != pair[:-1]]
        else:
            o = np.lexsort((second, rank[pos]))
            a, b, pos = rank[pos][o], second[o], pos[o]
            fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        sa[open_slots] = pos
        rank[pos] = np.maximum.accumulate(np.where(fresh, open_slots, 0)) + 1
        h *= 2


class FMIndex:
    """Self-index of a sequence of integers: count and locate without the sequence itself."""

    def __init__(self, seq: np.ndarray):
        n = self.n = len(seq)
        sa = suffix_array(seq)
        bwt = seq[sa - 1].astype(np.int32 if seq.max(initial=0) < 1 << 31 else np.int64)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=1))])
        self.sigma = len(self.starts) - 1
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        for shift in range(max(1, int(self.sigma - 1).bit_length()) - 1, -1, -1):
            bit = (bwt & (1 << shift)) != 0
            self.levels.append((*self._directory(bit), n - int(bit.sum())))
            bwt = np.concatenate([bwt[~bit], bwt[bit]])
        sampled = sa % SAMPLE == 0
        self.marks = self._directory(sampled)
        self.samples = sa[sampled]

    @staticmethod
    def _directory(bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        packed = np.packbits(bit, bitorder="little")
        block = np.concatenate([packed, np.zeros(8 - len(packed) % 8, np.uint8)]).view("<u8")
        return block, np.concatenate([[0], np.cumsum(np.bitwise_count(block), dtype=np.int64)])

    @staticmethod
    def _ones(directory: tuple[np.ndarray, np.ndarray], i: np.ndarray) -> np.ndarray:
        block, before = directory
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[w] + np.bitwise_count(block[w] & low)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol in the first i entries of the transform."""
        begin = np.zeros_like(i)
        for k, (block, before, zeros) in enumerate(self.levels):
            bit = symbol >> (len(self.levels) - 1 - k) & 1
            one_b, one_i = self._ones((block, before), begin), self._ones((block, before), i)
            begin = np.where(bit == 1, zeros + one_b, begin - one_b)
            i = np.where(bit == 1, zeros + one_i, i - one_i)
        return i - begin

    def symbol(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for block, before, zeros in self.levels:
            bit = (block[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            one = self._ones((block, before), i)
            i = np.where(bit == 1, zeros + one, i - one)
            out = out << 1 | bit
        return out

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of each row of patterns (padded on the right), symbols below sigma."""
        low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.n, np.int64)
        for back in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((back < lengths) & (low < high))
            if not len(live):
                break
            c = patterns[live, lengths[live] - 1 - back]
            low[live] = self.starts[c] + self.rank(c, low[live])
            high[live] = self.starts[c] + self.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, at, walked = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(rows):
            block, _ = self.marks
            hit = (block[rows >> 6] >> (rows & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            out[at[hit]] = self.samples[self._ones(self.marks, rows[hit])] + walked
            rows, at = rows[~hit], at[~hit]
            if len(rows):
                c = self.symbol(rows)
                rows = self.starts[c] + self.rank(c, rows)
            walked += 1
        return out


def windows_of(items: list[tuple[str | None, bytes | None]], window: int = WINDOW) -> list[tuple[tuple[bytes, ...], list[str]]]:
    """Distinct windows of (item id, text) with the ids of their items; items without words have none."""
    found: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            found[tuple(w[k : k + window])] |= {item} if item is not None else set()
    return [(k, sorted(v)) for k, v in found.items()]


def _merge(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of [start, end) rows; runs that touch are one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > reach[:-1]]
    return np.stack([spans[new, 0], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(reach) - 1]]], 1)


def hits(texts: list[list[bytes]], windows: list[tuple[tuple[bytes, ...], list[str]]]) -> tuple[list[np.ndarray], list[set[str]]]:
    """Merged word spans and item ids of each document of one shard."""
    n_docs = len(texts)
    ids: dict[bytes, int] = defaultdict(itertools.count(n_docs).__next__)  # sentinels come first: 0 .. n_docs - 1
    sizes = np.fromiter(map(len, texts), np.int64, n_docs)
    ends = np.cumsum(sizes + 1) - 1
    seq = np.empty(int(sizes.sum()) + n_docs, np.int64)
    is_end = np.zeros(len(seq), bool)
    is_end[ends] = True
    seq[ends] = np.arange(n_docs)
    seq[~is_end] = np.fromiter(map(ids.__getitem__, itertools.chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    ids.default_factory = None
    spans, items = [np.zeros((0, 2), np.int64)] * n_docs, [set() for _ in range(n_docs)]
    known = [k for k, (w, _) in enumerate(windows) if all(x in ids for x in w)]
    if not known:
        return spans, items
    lengths = np.array([len(windows[k][0]) for k in known])
    patterns = np.zeros((len(known), lengths.max()), np.int64)
    for row, k in enumerate(known):
        patterns[row, : lengths[row]] = [ids[x] for x in windows[k][0]]
    index = FMIndex(seq)
    low, high = index.search(patterns, lengths)
    count = high - low
    which = np.repeat(np.arange(len(known)), count)
    rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + low[which]
    at = index.locate(rows)
    doc = np.searchsorted(ends, at)
    start = at - (ends - sizes)[doc]
    for d, w in np.unique(np.stack([doc, which], 1), axis=0) if len(doc) else ():
        items[d].update(windows[known[w]][1])
    o = np.argsort(doc, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(doc[o]) > 0]) if len(o) else []
    for part in np.split(o, cut[1:]) if len(o) else ():
        spans[doc[part[0]]] = _merge(np.stack([start[part], start[part] + lengths[which[part]]], 1))
    return spans, items


_STATE = [
    T.StructField("__spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
    T.StructField("__items", T.ArrayType(T.StringType())),
    T.StructField("__n_words", T.LongType()),
]
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _pass(windows, shard_words: int):
    """Adds the hits of one broadcast of windows to the state columns of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        texts: list[list[bytes]] = []
        total = 0

        def flush():
            nonlocal held, texts, total
            spans, items = hits(texts, windows.value)
            sizes, texts = [len(t) for t in texts], []
            at = 0
            for b in held:
                old_spans, old_items = b.column("__spans").to_pylist(), b.column("__items").to_pylist()
                new_spans, new_items, n = [], [], []
                for k in range(b.num_rows):
                    before = np.array([(x["start"], x["stop"]) for x in old_spans[k]], np.int64).reshape(-1, 2)
                    merged = _merge(np.concatenate([before, spans[at + k]]))
                    new_spans.append([{"start": int(s), "stop": int(e)} for s, e in merged])
                    new_items.append(sorted(items[at + k].union(old_items[k])))
                    n.append(sizes[at + k])
                at += b.num_rows
                cols = [c for c in b.schema.names if not c.startswith("__")]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in cols), pa.array(new_spans, _SPAN), pa.array(new_items, pa.list_(pa.string())), pa.array(n, pa.int64())],
                    [*cols, "__spans", "__items", "__n_words"],
                )
            held, texts, total = [], [], 0

        for b in batches:
            held.append(b)
            for t in b.column("text").to_pylist():
                texts.append(words(t.encode() if isinstance(t, str) else t))
                total += len(texts[-1])
            if total >= shard_words:
                yield from flush()
        if held:
            yield from flush()

    return run


def _chain(steps: list[Callable]) -> Callable:
    """All steps in one worker, each on the batches of the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        yield from batches

    return run


def _passes(spark: SparkSession, benchmark: DataFrame, window: int, shard_words: int, pass_windows: int) -> list[Callable]:
    """The passes over the windows of the benchmark, one at least."""
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary"))
    out: list[Callable] = []
    block: list = []
    size = 0
    for r in itertools.chain(items.toLocalIterator(prefetchPartitions=False), [None]):
        if r is not None:
            block.append((r[0], bytes(r[1]) if r[1] is not None else None))
            size += len(r[1] or b"") // 2  # at most so many windows
        if size >= pass_windows or (r is None and (block or not out)):
            out.append(_pass(spark.sparkContext.broadcast(windows_of(block, window)), shard_words))
            block, size = [], 0
    return out


def _with_state(docs: DataFrame, cols: list[str]) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(*cols).withColumn("__spans", F.array().cast(_STATE[0].dataType)).withColumn("__items", F.array().cast("array<string>")).withColumn("__n_words", F.lit(0).cast("long"))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """docs with spans (merged word spans hit by windows), items (ids of items with occurring windows, sorted) and n_words.

    Null texts have no words. Items without words have no window; an item without an id hits words and names no item;
    rows that repeat an item count once. Columns of docs named spans, items, n_words or __* are replaced. An empty
    benchmark hits nothing; an empty docs gives no rows.
    """
    cols = [c for c in docs.columns if c not in ("spans", "items", "n_words") and not c.startswith("__")]
    schema = T.StructType([*(docs.schema[c] for c in cols), *_STATE])
    passes = _passes(docs.sparkSession, benchmark, window, shard_words, pass_windows)
    state = _with_state(docs, cols).mapInArrow(trimmed(_chain(passes)), schema)
    return state.select(*cols, F.col("__spans").alias("spans"), F.col("__items").alias("items"), F.col("__n_words").alias("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS // 4, pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """docs with every hit span cut from its text; documents without hits stay as they are, and so do all other columns.

    A span is cut from the first byte of its first word to the last byte of its last word. Null texts stay null, repeated rows are
    cut alike, and an empty benchmark cuts nothing; an empty docs gives no rows. Shards are smaller than find()'s, as whole
    records wait with them; a longer text is a shard of its own, and its index takes memory in proportion.
    """
    others = F.struct(F.lit(0).alias("__"), *(c for c in docs.columns if c != "text")).alias("record")
    given = docs.select("text", others)
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("record", given.schema["record"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
        for b in batches:
            texts, spans = b.column("text").to_pylist(), b.column("__spans").to_pylist()
            for k, cut in enumerate(spans):
                if cut:
                    raw = texts[k].encode()
                    at = [m.span() for m in word.finditer(raw)]
                    kept, end = [], 0
                    for s in cut:
                        kept.append(raw[end : at[s["start"]][0]])
                        end = at[s["stop"] - 1][1]
                    texts[k] = b"".join([*kept, raw[end:]]).decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), b.column("record")], ["text", "record"])

    passes = _passes(docs.sparkSession, benchmark, window, shard_words, pass_windows)
    cut = _with_state(given, given.columns).mapInArrow(trimmed(_chain([*passes, run])), schema)
    return cut.select(*(F.col("text") if c == "text" else F.col("record")[c].alias(c) for c in docs.columns))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in the whole documents table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


#: Every run of words of a document that is as long as some window, looked up among the windows.
ORACLE = rf"""
WITH raw AS (
  SELECT 'd' AS kind, row_number() OVER () AS rid, doc_id AS id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), item_id, text FROM benchmark),
t AS MATERIALIZED (
  SELECT kind, rid, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM raw),
i AS (SELECT id::VARCHAR AS item, w, least(len(w), {WINDOW}) AS size FROM t WHERE kind = 'b' AND len(w) > 0),
win AS MATERIALIZED (SELECT DISTINCT item, size, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS key FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS pos FROM i)),
runs AS (
  SELECT rid, size, pos, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS key
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM t, (SELECT DISTINCT size FROM win) s WHERE kind = 'd' AND len(w) >= size)),
hit AS MATERIALIZED (SELECT rid, runs.pos, runs.size, item FROM runs JOIN win USING (size, key)),
places AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(pos, pos + size)) AS place FROM (SELECT DISTINCT rid, pos, size FROM hit)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit WHERE item IS NOT NULL) GROUP BY rid)
SELECT t.id AS doc_id, len(t.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM t LEFT JOIN places ON places.rid = t.rid LEFT JOIN items ON items.rid = t.rid WHERE t.kind = 'd'
"""
