"""Phrase collocations by compressed position bitmaps, extended depth-first and counted over shards.

Texts are cut into pieces and words. A shard is SHARD_BYTES of text, about: its words stand on one line of positions, with an
empty position between pieces, so that no phrase leaves its piece. A word's bitmap holds only its blocks of 8 positions that
aren't empty, a byte each. To extend phrases by a word, their bitmaps are shifted by one position and ANDed with the bitmaps
of the words in the same blocks; bits that are left are occurrences, and popcounts count them. Batches of phrases of at most
GROUP occurrences are extended at a time, depth-first, so that a shard's memory is bounded whatever it holds.

What a shard counts is little by itself, so lengths are settled over all shards before longer ones are counted: hashes of the
phrases of one length are added up, and those that reach the least count go to a Bloom filter in the shared folder. A phrase is
extended only if the filters hold all its parts. A filter has FILTER_BITS bits at most: beyond that it lets more through, which
costs time and never a phrase, as the last pass adds up the phrases themselves, word by word, and that sum alone decides.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import bounded_batches, discard, materialise, scratch, table, trimmed
from docloom.llm.sorted_arrays import Store

#: Words of a phrase at most, occurrences at least, rows of a language, hundredths of a phrase's count at which a longer one replaces it.
LONGEST, LEAST, TOP, ABSORBS = 5, 100, 2000, 100
#: The language of documents without one.
NO_LANG = "und"
#: Bytes of text of a shard, occurrences that are extended at a time, rows of a batch that goes back to Spark.
SHARD_BYTES, GROUP, ROWS = 14 << 20, 1 << 17, 1 << 16
#: Shards of a task of the last pass where there are many, and rows of phrases that it adds up at a time.
TASK_SHARDS, HELD = 16, 1 << 19
#: Bits of a filter for each key, the least and the greatest number of all its bits (powers of two), and slices.
KEY_BITS, LEAST_BITS, FILTER_BITS, SLICES = 16, 20, 28, 64
#: Parts that the rows of one language are ranked in before the best of all are.
SALTS = 32

_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words end to end, text of each, whether a piece begins with it)."""
    texts = texts.cast(pa.large_string()) if len(texts) else pa.array([], pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(data):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, bool)
    kind = _KIND[data]
    inside = kind == 0
    first = np.zeros(len(data) + 1, bool)  # a text begins here
    first[offsets] = True
    starts = np.flatnonzero(inside & np.r_[True, ~inside[:-1] | first[1:-1]])
    ends = np.flatnonzero(inside & np.r_[~inside[1:] | first[1:-1], True]) + 1
    owner = np.searchsorted(offsets, starts, "right") - 1
    piece = owner + np.searchsorted(np.flatnonzero(kind == 2), starts)
    at = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(_LOWER[data[inside]]))
    return words, owner, np.diff(piece, prepend=-1) != 0


def _squeeze(a: np.ndarray) -> np.ndarray:
    """Numbers >= 0 below 2**32, most of them small, packed."""
    planes = a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return np.frombuffer(np.int64(len(a)).tobytes() + pa.compress(planes, codec="zstd", asbytes=True), np.uint8)


def _unsqueeze(a: np.ndarray) -> np.ndarray:
    n = int(np.frombuffer(a[:8].tobytes(), np.int64)[0])
    planes = np.frombuffer(pa.decompress(a[8:].tobytes(), n * 4, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def _shards(store: Store):
    """Writes shards; rows of (name, lang, word, hash, n): a shard's words and their counts."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        langs = pc.fill_null(t.column("lang"), NO_LANG).combine_chunks().dictionary_encode()
        words, owner, begins = cut(pc.fill_null(t.column("text"), "").combine_chunks())
        if not len(words):
            return
        coded = words.dictionary_encode()
        both = langs.indices.to_numpy()[owner].astype(np.int64) * len(coded.dictionary) + coded.indices.to_numpy()
        distinct, token, n = np.unique(both, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")  # frequent words get small numbers
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        distinct, n, token = distinct[order], n[order], number[token]
        line = np.zeros(len(token) + int(begins.sum()), np.int64)  # 0: no word
        line[np.arange(len(token)) + np.cumsum(begins)] = token + 1
        name = uuid.uuid4().hex
        lang = langs.dictionary.take(pa.array(distinct // len(coded.dictionary)))
        word = coded.dictionary.take(pa.array(distinct % len(coded.dictionary))).cast(pa.string())
        seeds = {x: xxhash.xxh64_intdigest(x.encode()) for x in langs.dictionary.to_pylist()}
        hashes = np.array([xxhash.xxh64_intdigest(w, seeds[x]) for w, x in zip(word.cast(pa.binary()).to_pylist(), lang.to_pylist())], np.uint64)
        store.put(f"line-{name}", _squeeze(line))
        store.put(f"hash-{name}", hashes)
        for what, col in (("lang", lang), ("word", word)):
            flat = pa.concat_arrays([col])
            store.put(f"{what}-{name}", np.frombuffer(pa.compress(b"".join(flat.cast(pa.binary()).to_pylist()), codec="zstd", asbytes=True), np.uint8))
            store.put(f"{what}s-{name}", _squeeze(pc.binary_length(flat).to_numpy()))
        for k in range(0, len(n), ROWS):
            rows = len(n[k : k + ROWS])
            yield pa.RecordBatch.from_arrays([pa.array([name] * rows), lang[k : k + ROWS], word[k : k + ROWS], pa.array(hashes[k : k + ROWS].view(np.int64)), pa.array(n[k : k + ROWS])], ["name", "lang", "word", "hash", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.column("text").nbytes
            if size >= SHARD_BYTES:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return run


class Filter:
    """A blocked Bloom filter of 64-bit hashes, written in slices by their leading bits."""

    def __init__(self, store: Store, name: str, bits: int):
        self.store, self.name, self.bits, self.words = store, name, bits, None

    def __getstate__(self):
        return self.__dict__ | {"words": None}

    @staticmethod
    def mask(h: np.ndarray) -> np.ndarray:
        one, low = np.uint64(1), np.uint64(63)
        return (one << (h & low)) | (one << ((h >> np.uint64(6)) & low)) | (one << ((h >> np.uint64(12)) & low))

    def place(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(70 - self.bits)).astype(np.int64)

    def holds(self, h: np.ndarray) -> np.ndarray:
        if self.words is None:
            each = (1 << self.bits - 6) // SLICES
            self.words = np.zeros(each * SLICES, np.uint64)
            for k in range(SLICES):
                some = self.store.read(f"{self.name}-{k}", np.uint64)
                self.words[k * each : k * each + len(some)] = some
        mask = self.mask(h)
        return self.words[self.place(h)] & mask == mask

    def write(self, keys: DataFrame) -> "Filter":
        """Writes the filter of the column hash, each slice in one task, key after key."""
        each = (1 << self.bits - 6) // SLICES

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slices: dict[int, np.ndarray] = {}
            for b in batches:
                h = b.column("hash").to_numpy().view(np.uint64)
                at = self.place(h)
                for k in np.unique(at // each).tolist():
                    own = at // each == k
                    np.bitwise_or.at(slices.setdefault(k, np.zeros(each, np.uint64)), at[own] - k * each, self.mask(h[own]))
            for k, words in slices.items():
                self.store.put(f"{self.name}-{k}", words)
            yield pa.RecordBatch.from_arrays([pa.array([len(slices)], pa.int32())], ["slices"])

        keys.repartition(SLICES, F.shiftrightunsigned("hash", 58)).select("hash").mapInArrow(trimmed(run), "slices int").agg(F.sum("slices")).collect()
        return self


def filter_of(keys: DataFrame, store: Store, name: str) -> Filter:
    return Filter(store, name, min(FILTER_BITS, max(LEAST_BITS, (KEY_BITS * keys.count()).bit_length()))).write(keys)


class Bitmaps:
    """Bytes of positions by item and block, sorted by item."""

    def __init__(self, item: np.ndarray, block: np.ndarray, bits: np.ndarray):
        self.item, self.block, self.bits = item, block, bits

    def __getitem__(self, some) -> "Bitmaps":
        return Bitmaps(self.item[some], self.block[some], self.bits[some])

    def batches(self) -> Iterator["Bitmaps"]:
        """Parts of GROUP occurrences at most; the bitmap of an item may be in two."""
        upto = np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)
        edges = np.searchsorted(upto, np.arange(0, upto[-1] if len(upto) else 0, GROUP), "right").tolist()
        for a, b in zip(edges, [*edges[1:], len(upto)]):
            if a < b:
                yield self[a:b]

    def shifted(self) -> "Bitmaps":
        """One position on; what leaves its block goes to the next."""
        low, carry = self.bits << np.uint8(1), self.bits >> np.uint8(7)
        a, b = np.flatnonzero(low), np.flatnonzero(carry)
        return Bitmaps(np.r_[self.item[a], self.item[b]], np.r_[self.block[a], self.block[b] + 1], np.r_[low[a], carry[b]])


def mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase and one word more."""
    x = (h * _ODD) ^ word
    x = (x ^ (x >> np.uint64(30))) * _ODD2
    return x ^ (x >> np.uint64(27))


class Line:
    """The frequent words of a shard as bitmaps, and the search over them."""

    def __init__(self, line: np.ndarray, hashes: np.ndarray, filters: list[Filter]):
        self.filters = filters
        self.kept = np.flatnonzero(filters[0].holds(hashes))
        self.hashes = hashes[self.kept]
        number = np.full(len(hashes) + 1, -1, np.int32)
        number[self.kept + 1] = np.arange(len(self.kept))
        word = number[line]
        at = np.flatnonzero(word >= 0)
        key = (at >> 3) * max(1, len(self.kept)) + word[at]
        order = np.argsort(key, kind="stable")
        key, bit = key[order], np.uint8(1) << (at[order] & 7).astype(np.uint8)
        del at, order
        edges = np.flatnonzero(np.diff(key, prepend=-1))
        bits = np.bitwise_or.reduceat(bit, edges) if len(edges) else bit
        block, word = np.divmod(key[edges], max(1, len(self.kept)))
        self.word, self.bits = word, bits
        self.first = np.searchsorted(block, np.arange((len(line) >> 3) + 3))
        self.words = Bitmaps(word, block, bits)[np.argsort(word, kind="stable")]

    def extend(self, phrases: Bitmaps) -> tuple[np.ndarray, np.ndarray, Bitmaps]:
        """(phrase and word of each extension that occurs, bitmaps of the extensions)."""
        moved = phrases.shifted()
        n = self.first[moved.block + 1] - self.first[moved.block]
        left = np.repeat(np.arange(len(n)), n)
        right = np.arange(len(left)) + np.repeat(self.first[moved.block] - (np.cumsum(n) - n), n)
        bits = moved.bits[left] & self.bits[right]
        hit = np.flatnonzero(bits)
        left, right = left[hit], right[hit]
        pair = moved.item[left] * len(self.kept) + self.word[right]
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        new = np.diff(pair, prepend=-1) != 0
        item, word = np.divmod(pair[new], len(self.kept))
        return item, word, Bitmaps(np.cumsum(new) - 1, moved.block[left[order]], bits[hit[order]])

    def search(self, longest: int, phrases: Bitmaps | None = None, words: np.ndarray | None = None, all_lengths: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Batches of (words by phrase, hash, occurrences) of phrases of longest words, or of 2 to longest words, whose parts the filters hold.

        A phrase of a length for which there is a filter must be in it. One phrase may come in several batches, each with its share.
        """
        if words is None:
            phrases, words = self.words, np.arange(len(self.kept))[:, None]
        size = words.shape[1] + 1
        for batch in phrases.batches():
            base = int(batch.item[0])
            some = words[base : int(batch.item[-1]) + 1]
            item, word, found = self.extend(Bitmaps(batch.item - base, batch.block, batch.bits))
            made = np.column_stack([some[item], word])
            keep = np.ones(len(made), bool)
            if size > 2:
                keep = self.filters[size - 2].holds(self._hash(made[:, 1:]))
            h = self._hash(made)
            if size <= len(self.filters):
                keep &= self.filters[size - 1].holds(h)
            if not keep.all():
                number = np.cumsum(keep) - 1
                found = found[keep[found.item]]
                found.item, made, h = number[found.item], made[keep], h[keep]
            if not len(made):
                continue
            if all_lengths or size == longest:
                yield made, h, np.bincount(found.item, np.bitwise_count(found.bits), len(made)).astype(np.int64)
            if size < longest:
                yield from self.search(longest, found, made, all_lengths)

    def _hash(self, made: np.ndarray) -> np.ndarray:
        h = self.hashes[made[:, 0]]
        for k in range(1, made.shape[1]):
            h = mixed(h, self.hashes[made[:, k]])
        return h


def _line(store: Store, name: str, filters: list[Filter]) -> Line:
    return Line(_unsqueeze(store.read(f"line-{name}", np.uint8)).astype(np.int32), np.array(store.read(f"hash-{name}", np.uint64)), filters)


def _count(store: Store, filters: list[Filter], size: int):
    """(hash, n) of the phrases of size words of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("name").to_pylist():
                for _, h, n in _line(store, name, filters).search(size):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["hash", "n"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, size, n) of the shards of a task added up, HELD rows at a time."""

    def total(held: list[pa.RecordBatch]) -> pa.Table:
        t = pa.Table.from_batches(held).group_by(["lang", "phrase", "size"], use_threads=False).aggregate([("n", "sum")])
        return t.select(["lang", "phrase", "size", "n_sum"]).rename_columns(["lang", "phrase", "size", "n"])

    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += len(b)
        if rows >= HELD:
            t = total(held)
            if len(t) > HELD // 2:
                yield from t.to_batches(ROWS)
                held, rows = [], 0
            else:
                held, rows = t.to_batches(), len(t)
    if held:
        yield from total(held).to_batches(ROWS)


def _spell(store: Store, filters: list[Filter], longest: int):
    """(lang, phrase, size, n) of the phrases of shards that the filters hold, the shards of a task added up."""

    def strings(name: str, what: str) -> pa.Array:
        sizes = _unsqueeze(store.read(f"{what}s-{name}", np.uint8)).astype(np.int64)
        data = pa.decompress(store.read(f"{what}-{name}", np.uint8).tobytes(), int(sizes.sum()), codec="zstd")
        return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(np.r_[0, np.cumsum(sizes)]), data if isinstance(data, pa.Buffer) else pa.py_buffer(data))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("name").to_pylist():
                line = _line(store, name, filters)
                kept = pa.array(line.kept)
                word, lang = strings(name, "word").take(kept), strings(name, "lang").take(kept)
                for made, _, n in line.search(longest, all_lengths=True):
                    cols = [word.take(pa.array(made[:, k])) for k in range(made.shape[1])]
                    phrase = pc.binary_join_element_wise(*cols, pa.scalar(" ", pa.large_string())).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([lang.take(pa.array(made[:, 0])).cast(pa.string()), phrase, pa.array(np.full(len(n), made.shape[1]), pa.int32()), pa.array(n)], ["lang", "phrase", "size", "n"])

    return lambda batches: _summed(each(batches))


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, f) of all phrases of 1 to longest words with at least `least` occurrences, (lang, n) with all words counted)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    store = Store(f"{scratch(spark)}/docloom-phrases-{uuid.uuid4().hex}")
    # names are drawn anew when a task is repeated, so they are written down before anything is read by them
    parts = materialise(docs.select("lang", "text").mapInArrow(trimmed(_shards(store)), "name string, lang string, word string, hash long, n long"), "words")
    totals = materialise(parts.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    words = materialise(parts.groupBy("lang", "word", "hash").agg(F.sum("n").alias("f")).where(F.col("f") >= least), "frequent")
    names = materialise(parts.select("name").distinct(), "shards")
    discard(parts)
    cores, n = spark.sparkContext.defaultParallelism, names.count()
    shards, few = names.repartition(max(cores, n), "name"), names.repartition(max(2 * cores, n // TASK_SHARDS), "name")
    filters = [filter_of(words, store, "filter-1")]
    for size in range(2, longest):
        counted = shards.mapInArrow(trimmed(_count(store, filters, size)), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        keys = materialise(counted.select("hash"), f"keys-{size}")
        filters.append(filter_of(keys, store, f"filter-{size}"))
        discard(keys)
    spelt = few.mapInArrow(trimmed(_spell(store, filters, longest)), "lang string, phrase string, size int, n long") if longest > 1 else None
    phrases = words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "f")
    if spelt is not None:
        phrases = phrases.unionByName(spelt.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("f")).where(F.col("f") >= least))
    return materialise(phrases, "phrases"), totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, absorbs: int = ABSORBS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to longest words with at least `least` occurrences.

    docs holds (lang, text); other columns, whatever their names, take no part. A null lang is NO_LANG, a null text is empty;
    repeated rows are documents of their own, and texts may have any length. A score is that of the cut that binds least,
    floor(1000 a n / (l r)) in exact numbers, ties to the shortest first part. Phrases inside a longer one with at least absorbs
    hundredths of their occurrences are dropped. Ties in score go to more occurrences, then to the smaller phrase. No words, no rows.
    """
    f, totals = frequent(docs, least, longest)
    some = f.where(F.col("size") > 1)
    words, k = F.split("phrase", " "), F.col("k")
    first, rest = F.array_join(F.slice(words, 1, k), " "), F.array_join(F.slice(words, k + 1, F.col("size") - k), " ")
    # a longer phrase counts no more often than what lies between it and the shorter one, so one word more decides
    longer = some.where(F.col("size") > 2).select("lang", F.explode(F.array(F.array_join(F.slice(words, F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("size") - 1), " "))).alias("phrase"), F.col("f").alias("longer"))
    longest_of = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = some.join(longest_of, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < absorbs * F.col("f"), F.lit(True))).select("lang", "phrase", "size", F.col("f").alias("a"))
    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select("lang", "phrase", "a", "k", first.alias("first"), rest.alias("rest"))
    of = lambda part, name: f.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    both = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = both.withColumns({"up": (wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)"), "down": (wide("l") * wide("r")).cast("decimal(38,0)")}).withColumn("score", F.expr("up div down"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # the best of each part of a language first, so that no task gets all phrases of a large one
    few = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of 2 to 5 words of each language."""
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE = f"""
WITH d AS (SELECT coalesce(lang, '{NO_LANG}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS words FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest(range(1, {LONGEST + 1})) AS k)),
f AS MATERIALIZED (SELECT lang, k AS size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
t AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
c AS MATERIALIZED (
  SELECT lang, phrase, size, f FROM f x WHERE size > 1 AND NOT EXISTS (
    SELECT 1 FROM f y WHERE y.lang = x.lang AND y.size > x.size AND 100 * y.f >= {ABSORBS} * x.f AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' '))),
s AS (
  SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, t.n, (1000 * c.f::HUGEINT * t.n // (l.f::HUGEINT * r.f))::BIGINT AS score, z.k
  FROM c JOIN (SELECT unnest(range(1, {LONGEST})) AS k) z ON z.k < c.size JOIN t ON t.lang = c.lang
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(string_split(c.phrase, ' ')[:z.k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(string_split(c.phrase, ' ')[z.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= {TOP}
"""
