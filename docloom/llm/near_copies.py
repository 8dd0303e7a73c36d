"""Groups of near copies: texts whose sets of five-word shingles have a Jaccard similarity of SIMILARITY or more.

1. SimHash fingerprints of the sets are linked by multi-index hashing (simhash.links). Pairs that close are near copies as
   a rule, but 64 bits can't decide this similarity: most pairs of 0.8 differ in more bits than balls can reach.
2. So the rest is found by prefix filtering, which misses none: shingles have one order for all texts (those often seen in
   a sample last, then by hash), and two sets that are so similar share one of the first n - ceil(0.8 n) + 1 of each. Under
   each such shingle every set is compared with one other, the hub: the set whose shingles are seen most often.
3. Then come those pairs under one shingle that still lie in different components, the smaller set by size. As its partner has
   at least its size, the smaller set's first n - ceil(8/9 n) + 1 shingles are enough: pages that share a template, with more
   of their own than near copies can have, don't meet on it. A shingle of many sets is dealt to tasks in pairs of blocks.

Parities of hashed shingles, 2 bits a shingle or more, bound a pair's difference from below, so that only pairs near the limit
are left; they are kept as arrays in the shared folder, by set. In step 3 they are looked up where the sets of a shingle
meet, before any pair is written.

Shingles of one set only never leave the tasks that find them: those of several are kept as sorted arrays in the shared
folder, and so are the rows whose texts candidates need. Each text then goes once to each set that it is compared with, and
a set with very many partners is compared in several tasks. All candidates are verified on their texts. The order and the hubs are free to choose, so the sample decides the work only,
never the pairs. Equal sets are one. Of the rest only what links groups matters, so a large group of near copies costs its
size where one of them is close to the others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import simhash
from docloom.llm.common import Shared, bounded_batches, discard, materialise, row_key, scratch, trimmed
from docloom.llm.sorted_arrays import Arrays, Store, part_bits, store_arrays

SHINGLE = 5
#: Least Jaccard similarity, as a fraction.
SIMILARITY = (4, 5)
#: Rows of the sample that the order of shingles is made from, about; shingles of fewer than HOT of its sets aren't listed.
SAMPLE, HOT, MAX_HOT = 5_000, 3, 200_000
PARITIES = 8
#: Partners of a set that one task compares it with, about.
PARTNERS = 2_000
#: Sets of a shingle that one task compares with as many others, about.
BLOCK = 2_048


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of a text; a shorter text is one shingle, one without words has none."""
    words = (text or b"").lower().split()
    grams = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)] if words else []
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64)).view(np.int64)


def parities(s: np.ndarray) -> np.ndarray:
    """Words of 64 bits, PARITIES or a multiple of it by a power of two: whether an even or odd number of shingles falls on each bit. Sets differ in as many shingles as these differ in bits, at least."""
    bits = max(64 * PARITIES, 1 << (2 * len(s) - 1).bit_length()) if len(s) else 64 * PARITIES
    return np.packbits(np.bincount(s & (bits - 1), minlength=bits).astype(np.uint8) & 1, bitorder="little").view("<i8")


def folded(words: np.ndarray, n: int) -> np.ndarray:
    """Parities in n words instead of more."""
    return np.bitwise_xor.reduce(words.reshape(-1, n), axis=0)


def may_be_similar(a: np.ndarray, b: np.ndarray, sizes: int) -> bool:
    """Whether sets of these parities can be similar, by the sum of their sizes: they differ in (q - p) / (q + p) of it at most."""
    p, q = SIMILARITY
    n = min(len(a), len(b))
    return int(np.bitwise_count((folded(a, n) ^ folded(b, n)).view(np.uint64)).sum()) * (p + q) <= sizes * (q - p)


class Parities:
    """Parities and sizes of sets by their ids, in parts in the shared folder."""

    def __init__(self, sets: DataFrame, root: str, entries: int):
        store, bits = Store(root), part_bits(entries)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if held:
                t = pa.Table.from_batches(held).combine_chunks()
                ids = t.column("id").to_numpy().view(np.uint64)
                t = t.take(pa.array(np.argsort(ids)))
                ids, words = t.column("id").to_numpy().view(np.uint64), t.column("parity").chunk(0)
                size, flat = np.diff(words.offsets.to_numpy()), words.flatten().to_numpy()
                begin = np.cumsum(size) - size
                part = ids >> np.uint64(64 - bits)
                for p in np.unique(part).tolist():
                    mine = np.flatnonzero(part == p)
                    a, b = begin[mine[0]], begin[mine[-1]] + size[mine[-1]]
                    store.put(f"parity-{p}", ids[mine])
                    store.put(f"parity-begin-{p}", begin[mine] - a)
                    store.put(f"parity-size-{p}", size[mine].astype(np.int64))
                    store.put(f"parity-n-{p}", t.column("n").to_numpy()[mine].astype(np.int64))
                    store.put(f"parity-words-{p}", flat[a:b])
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32())], ["part"])

        dealt = sets.select("id", "n", "parity").repartition(1 << bits, F.shiftrightunsigned("id", 64 - bits))
        dealt.mapInArrow(trimmed(run), "part int").agg(F.count("*")).collect()
        self.arrays = Arrays(store, "parity", np.uint64, bits, 64, dict.fromkeys(("begin", "size", "n", "words"), np.int64))

    def of(self, ids: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """(words of each set, their sizes)."""
        number = self.arrays.find(ids.view(np.uint64))
        begin, size = self.arrays.take("begin", number), self.arrays.take("size", number)
        words = [self.arrays.part(p, "words")[b : b + k] for p, b, k in zip((number >> Arrays.AT).tolist(), begin.tolist(), size.tolist())]
        return words, self.arrays.take("n", number)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    p, q = SIMILARITY
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * (p + q) >= p * (len(a) + len(b))


def _set_id(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), 7)).view(np.int64))


def _all_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]).astype(np.int64))], ["shingle"])


def _often(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that many texts of a sample have, and how many."""
    every = max(1, docs.count() // SAMPLE)
    texts = docs.select(F.col("text").cast("binary").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).distinct()
    counted = texts.mapInArrow(trimmed(_all_shingles), "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= HOT)
    rows = counted.orderBy(F.desc("n"), "shingle").limit(MAX_HOT).toArrow()  # at most MAX_HOT rows
    keys, n = rows["shingle"].to_numpy(), rows["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


_FOUND = "doc_id long, row_key long, id long, n int, fp long, seen long, parity array<long>, prefix array<long>"


def _prefixes(often: Shared) -> Callable:
    """Of each text: the name, size, fingerprint and parities of its set, how often its shingles are seen on average, and the first of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, count = often.value()
        p, q = SIMILARITY
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                s = shingles(t)
                rank = np.zeros(len(s), np.int64)
                if len(keys) and len(s):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    rank = np.where(keys[at] == s, count[at], 0)
                first = s[np.lexsort((s, rank))][: len(s) + (-p * len(s) // q) + 1] if len(s) else s
                seen = int(1000 * rank.sum() / len(s)) if len(s) else 0
                rows.append((_set_id(s), len(s), simhash.majority(s.view(np.uint64)), seen, parities(s), first))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), *cols], ["doc_id", "row_key", "id", "n", "fp", "seen", "parity", "prefix"])

    return run


def _shared_keys(keys: Arrays) -> Callable:
    """(key, id, n, seen, k) of the first shingles that other sets have too; k is their place, from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prefix = b.column("prefix")
            size, flat = np.diff(prefix.offsets.to_numpy()), prefix.flatten().to_numpy()
            distinct, back = np.unique(flat.view(np.uint64), return_inverse=True)
            hit = (keys.find(distinct) >= 0)[back]
            row = np.repeat(np.arange(b.num_rows), size)[hit]
            place = (np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + 1)[hit]
            yield pa.RecordBatch.from_arrays([pa.array(flat[hit]), *(b.column(c).take(pa.array(row)) for c in ("id", "n", "seen")), pa.array(place.astype(np.int32))], ["key", "id", "n", "seen", "k"])

    return run


_SENT = "a long, salt long, b long, text binary"


def _send(wanted: Arrays) -> Callable:
    """Texts to the sets that they are compared with: (a, salt, b, text); the set's own text has a null b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, n = wanted.spans(b.column("row_key").to_numpy().view(np.uint64))
            row = np.repeat(np.arange(b.num_rows), n)
            number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            a, salt, own, other = (wanted.take(c, number) for c in ("a", "salt", "own", "b"))
            for k in range(0, len(row), 100):
                part = slice(k, k + 100)
                yield pa.RecordBatch.from_arrays([pa.array(a[part]), pa.array(salt[part]), pa.array(other[part], mask=own[part] == 1), b.column("text").take(pa.array(row[part]))], ["a", "salt", "b", "text"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that are similar; rows come sorted by a and salt, a's own text first."""
    now, mine = None, np.zeros(0, np.int64)
    for batch in batches:
        keep = []
        for a, salt, b, t in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b", "text"))):
            if b is None:
                now, mine = (a, salt), shingles(t)
            keep.append(b is not None and now == (a, salt) and similar(mine, shingles(t)))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, parities_: Parities) -> DataFrame:
    """Those of the candidates (a, b) that are similar, by the texts of one row of each set (sets: id, row_key)."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("row_key").alias(f"{x}_row"))
    close = pairs.distinct().mapInArrow(trimmed(_close(parities_)), "a long, b long")
    close = materialise(close.join(side("a"), "a").join(side("b"), "b"), "candidates")
    partners = close.groupBy("a", "a_row").agg(F.count("*").alias("partners"))
    tasks = F.ceil(F.col("partners") / F.lit(PARTNERS)).cast("long")
    own = partners.select(F.col("a_row").alias("row_key"), "a", F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1)).alias("salt"), F.lit(1).cast("long").alias("own"), F.lit(0).cast("long").alias("b"))
    others = close.join(partners.select("a", tasks.alias("tasks")), "a").select(F.col("b_row").alias("row_key"), "a", F.pmod(F.xxhash64("b"), F.col("tasks")).alias("salt"), F.lit(0).cast("long").alias("own"), "b")
    wanted = store_arrays(own.unionByName(others), f"{scratch(docs.sparkSession)}/docloom-near-{uuid.uuid4().hex}", "wanted", close.count())
    texts = docs.select(row_key().alias("row_key"), F.col("text").cast("binary").alias("text")).mapInArrow(trimmed(_send(wanted)), _SENT)
    sorted_ = texts.repartition("a", "salt").sortWithinPartitions(F.col("a"), F.col("salt"), F.col("b").asc_nulls_first())
    return sorted_.mapInArrow(trimmed(_verify), "a long, b long").distinct()


def _close(parities_: Parities) -> Callable:
    """Those of pairs (a, b) that can be similar by their parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pair = np.stack([b.column(c).to_numpy() for c in ("a", "b")])
            ids, back = np.unique(pair, return_inverse=True)
            words, n = parities_.of(ids)
            x, y = back.reshape(pair.shape)
            keep = [may_be_similar(words[i], words[j], int(n[i] + n[j])) for i, j in zip(x.tolist(), y.tolist())]
            yield b.filter(pa.array(keep, pa.bool_()))

    return run


def _cross(parities_: Parities) -> Callable:
    """Pairs (a, b) of different roots that can be similar. Rows (key, x, y, small, id, n, root) come sorted by key and blocks x, y: each small one is compared with the others of its block that are no smaller."""
    p, q = SIMILARITY

    def pairs(small: np.ndarray, ids: np.ndarray, n: np.ndarray, root: np.ndarray) -> Iterator[pa.RecordBatch]:
        left, right = np.flatnonzero(small), np.flatnonzero(~small)
        if not len(left) or not len(right) or (root == root[0]).all():
            return
        right = right[np.argsort(n[right], kind="stable")]
        distinct, at = np.unique(ids, return_inverse=True)
        words, _ = parities_.of(distinct)
        short = np.stack([folded(w, PARITIES) for w in words]).view(np.uint64)
        near, sizes, others, known = short[at[right]], n[right], root[right], ids[right]
        found = []
        for i in left.tolist():
            start, stop = np.searchsorted(sizes, [n[i], n[i] * q // p + 1])
            rest = np.flatnonzero((others[start:stop] != root[i]) & ((sizes[start:stop] > n[i]) | (known[start:stop] > ids[i]))) + start
            differ = np.bitwise_count(near[rest] ^ short[at[i]]).sum(axis=1, dtype=np.int64)
            rest = rest[differ * (p + q) <= (sizes[rest] + n[i]) * (q - p)]
            found += [(ids[i], known[j]) for j in rest.tolist() if may_be_similar(words[at[i]], words[at[right[j]]], int(n[i] + sizes[j]))]
            if len(found) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def begins(cols: list[np.ndarray]) -> np.ndarray:
            new = np.ones(len(cols[0]), bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:3]])
            return np.flatnonzero(new)

        def done(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            edge = np.r_[begins(cols), len(cols[0])]
            for a, b in zip(edge[:-1], edge[1:]):
                yield from pairs(*(c[a:b] for c in cols[3:]))

        for b in batches:
            if not b.num_rows:
                continue
            held.append([b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "x", "y", "small", "id", "n", "root")])
            if any(held[0][c][0] != held[-1][c][-1] for c in range(3)):  # the last block may go on
                cols = [np.concatenate(x) for x in zip(*held)]
                cut = int(begins(cols)[-1])
                yield from done([c[:cut] for c in cols])
                held = [[c[cut:] for c in cols]]
        if held:
            yield from done([np.concatenate(x) for x in zip(*held)])

    return run


def _may_match(n: str, m: str):
    """Sets of these sizes can be similar."""
    p, q = SIMILARITY
    return (F.col(n) * q >= F.col(m) * p) & (F.col(m) * q >= F.col(n) * p)


def _pair(a: str, b: str) -> list:
    """Any of the two may be the set that the other's text is sent to."""
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, root) for every row of docs; rows of one root are connected by similar pairs.

    Texts without words (null, empty, blank) are copies of each other. A text of fewer than five words is one shingle. Repeated
    rows and ids stay rows of their own. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    often = Shared(docs.sparkSession, _often(docs))
    src = docs.select(F.col("doc_id").cast("long"), row_key().alias("row_key"), F.col("text").cast("binary").alias("text"))
    found = materialise(src.mapInArrow(trimmed(_prefixes(often)), _FOUND), "prefixes")
    sets = materialise(found.select("id", "row_key", "n", "fp", "parity").dropDuplicates(["id"]), "sets")
    words = Parities(sets, f"{scratch(docs.sparkSession)}/docloom-near-{uuid.uuid4().hex}", sets.count())
    # 1: fingerprints close to each other, each by its least set, and sets of one fingerprint
    least = sets.groupBy("fp").agg(F.min("id").alias("id"))
    same = sets.select("id", "fp").join(least.withColumnRenamed("id", "first"), "fp").where("id <> first").select(*_pair("id", "first"))
    close = simhash.links(least.select("fp"))
    close = close.join(least.select(F.col("fp").alias("a"), F.col("id").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("id").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # 2: sets and hubs under one shingle
    several = found.select("id", F.explode("prefix").alias("key")).groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key")
    several = materialise(several, "keys")
    stored = store_arrays(several, f"{scratch(docs.sparkSession)}/docloom-near-{uuid.uuid4().hex}", "key", several.count())
    shared = materialise(found.select("id", "n", "seen", "prefix").mapInArrow(trimmed(_shared_keys(stored)), "key long, id long, n int, seen long, k int").distinct(), "shared")
    hubs = shared.groupBy("key").agg(F.max(F.struct("seen", "n", "id")).alias("hub")).select("key", F.col("hub.id").alias("hub"), F.col("hub.n").alias("m"))
    near = shared.join(hubs, "key").where((F.col("id") != F.col("hub")) & _may_match("m", "n")).select(F.col("hub").alias("a"), F.col("id").alias("b"))
    edges = materialise(_verified(same.union(close).union(near), docs, sets, words), "links")
    roots = simhash.components(edges)
    # 3: members of different components under one shingle
    p, q = SIMILARITY
    first = F.expr(f"k <= n - (n * {2 * p} + {p + q - 1}) div {p + q} + 1")
    members = shared.select("key", "id", "n", first.alias("first")).join(roots, F.col("id") == F.col("node"), "left").select("key", "id", "n", "first", F.coalesce("root", "id").alias("root"))
    counted = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count_if("first").alias("small"), F.count("*").alias("all"))
    apart = counted.where("low < high AND small > 0").select("key", F.ceil(F.col("small") / F.lit(BLOCK)).alias("xs"), F.ceil(F.col("all") / F.lit(BLOCK)).alias("ys"))
    dealt, zero = materialise(members.join(apart, "key"), "members"), F.lit(0).cast("long")
    block = lambda c: F.pmod(F.xxhash64("id"), F.col(c))
    side = lambda rows, small, x, y: rows.select("key", x.alias("x"), y.alias("y"), F.lit(small).alias("small"), "id", "n", "root")
    rows = side(dealt.where("first"), True, block("xs"), F.explode(F.sequence(zero, F.col("ys") - 1))).unionByName(side(dealt, False, F.explode(F.sequence(zero, F.col("xs") - 1)), block("ys")))
    rows = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    cross = rows.mapInArrow(trimmed(_cross(words)), "a long, b long")
    more = materialise(_verified(cross, docs, sets, words), "links")
    roots = simhash.components(edges.union(more))
    discard(shared)
    discard(dealt)
    return found.join(roots, found.id == roots.node, "left").select("doc_id", "row_key", F.coalesce("root", "id").alias("root"))
