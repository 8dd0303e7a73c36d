"""Interpolated modified Kneser-Ney n-gram model (order 3 or 2), counted in Spark and scored from memory-mapped sorted hash arrays.

1. Words of the training documents are counted. Their 63-bit hashes are dealt by leading bits to parts; each part is a
   sorted array of hashes, and words are numbered part by part from the most frequent on, so that frequent words have
   small numbers.
2. Each text is led by order - 1 starts and closed by an end. Its n-grams are counted, added up in each task first, and
   dealt by a hash of all their words, so that no frequent word or pair gathers. The task that stores a part's counts
   sends on what each n-gram adds to its two pairs of words: to the pair it ends in, one distinct predecessor; to the
   pair it begins with, its count as a follower.
3. Pairs are summed and stored alike; they send on what they add to their words. Words are summed and stored last.
4. Scoring tasks map the files and look up the distinct n-grams of a chunk of texts at once.

What tasks send each other is packed: word numbers and counts in columns, by bytes, compressed. Pieces that would get too
small, because they are dealt to very many parts, are dealt in two steps. Files lie in the shared folder; a part is written
under its final name in one step and is the same whenever a task is repeated. Part sizes are bounded by more parts, so the
memory of a task doesn't grow with the corpus.

N-grams are told apart by over 32 bits more of a hash than it takes to number those of a part (see Hashed), pairs by all
their bits where these are no more.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import bounded_batches, fold, scratch, table, trimmed
from docloom.llm.sorted_arrays import Arrays, Hashed, Store, added, pack, part_bits, unpack

ORDER = 3
FOLDS, HELD_OUT = 5, 1
#: Bytes of text that are coded at a time, about.
CHUNK = 4 << 20
#: Leading bits that one step of dealing tells apart.
HOP_BITS = 10
#: What a packed piece holds. SUMMARY travels on to the driver, a row a part.
GRAMS, LEFTS, CONTEXTS, WORDS, SUMMARY = range(5)
_PIECE = "part int, kind int, piece binary"
_ODD, _ODD2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct hashes, place of each word among them, words of each text): runs of bytes that aren't ASCII white space, A-Z in lower case."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = lists.flatten()
    some = pc.greater(pc.binary_length(flat), 0)  # white space at either end leaves an empty word
    sizes = np.bincount(pc.list_parent_indices(lists).filter(some).to_numpy(), minlength=len(texts))
    coded = flat.filter(some).dictionary_encode()
    hashed = xxhash.xxh64_digest
    h = np.frombuffer(b"".join([hashed(w, 7) for w in _cut(coded.dictionary)]), ">u8").astype(np.uint64) >> np.uint64(1)
    distinct, place = np.unique(h.astype(np.int64), return_inverse=True)
    return distinct, place[coded.indices.to_numpy()], sizes


def _cut(words: pa.StringArray) -> list[bytes]:
    """The bytes of each word, none of them null; to_pylist() takes several times as long."""
    _, ends, data = words.buffers()
    if data is None:
        return [b""] * len(words)
    at = np.frombuffer(ends, np.int32)[words.offset : words.offset + len(words) + 1].tolist()
    data = data.to_pybytes()
    return [data[a:b] for a, b in zip(at, at[1:])]


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK) -> Iterator[tuple[list[pa.RecordBatch], pa.Array]]:
    """Batches of about limit bytes of text, with their texts; null texts are empty."""
    held, n = [], 0

    def texts() -> pa.Array:
        cols = [b.column("text") for b in held]
        return pc.fill_null(pa.concat_arrays([c if pa.types.is_string(c.type) else c.view(pa.string()) for c in cols]), "")

    for b in batches:
        held.append(b)
        n += pc.sum(pc.binary_length(b.column("text"))).as_py() or 0
        if n >= limit:
            yield held, texts()
            held, n = [], 0
    if held:
        yield held, texts()


def ngrams(ids: np.ndarray, sizes: np.ndarray, order: int, start: int, end: int) -> list[np.ndarray]:
    """The words at each place of all n-grams, first to last; each text is led by starts and closed by end."""
    stops = np.cumsum(sizes + 1)
    last = np.empty(len(ids) + len(sizes), np.int64)
    closed = np.zeros(len(last), bool)
    closed[stops - 1] = True
    last[closed], last[~closed] = end, ids
    cols = [last]
    for _ in range(order - 1):
        before = np.empty_like(last)
        before[1:] = cols[0][:-1]
        before[stops - 1 - sizes] = start
        cols.insert(0, before)
    return cols


class Keys:
    """Sortable keys of pairs of word numbers below 2**bits: 2 * bits of a one-to-one mixture, at the top of 64; and hashes of triples."""

    def __init__(self, bits: int):
        self.bits, self.wide = bits, 2 * bits
        self.mask = np.uint64((1 << self.wide) - 1)
        self.odd = np.uint64(_ODD & ((1 << self.wide) - 1))

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = (a.astype(np.uint64) << np.uint64(self.bits) | b.astype(np.uint64)) * self.odd & self.mask
        k = (k ^ (k >> np.uint64(self.bits))) * self.odd & self.mask
        return k << np.uint64(64 - self.wide)

    def row(self, ids: list[np.ndarray]) -> np.ndarray:
        pair = self.pair(*ids[:2])
        return pair if len(ids) == 2 else self.triple(ids[2], pair)

    @staticmethod
    def triple(first: np.ndarray, pair: np.ndarray) -> np.ndarray:
        h = (pair ^ (pair >> np.uint64(29))) * np.uint64(_ODD) + first.astype(np.uint64) * np.uint64(_ODD2)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(_ODD)
        return h ^ (h >> np.uint64(31))


def _pieces(kind: int, part: np.ndarray, cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A packed piece for each part; rows come grouped by part, and sorted by the first column inside."""
    edge = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)] if len(part) else [0]
    for k in range(0, len(edge) - 1, 1000):
        ends = list(zip(edge[k : k + 1000], edge[k + 1 : k + 1001]))
        blobs = [pack(*(c[a:b] for c in cols)) for a, b in ends]
        yield pa.RecordBatch.from_arrays([pa.array([int(part[a]) for a, _ in ends], pa.int32()), pa.array([kind] * len(ends), pa.int32()), pa.array(blobs, pa.binary())], ["part", "kind", "piece"])


def _summary(value: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([value.get("part", 0)], pa.int32()), pa.array([SUMMARY], pa.int32()), pa.array([json.dumps(value).encode()], pa.binary())], ["part", "kind", "piece"])


def _received(batches: Iterator[pa.RecordBatch]) -> tuple[dict[tuple[int, int], list], list[pa.RecordBatch]]:
    """({(part, kind): pieces}, summaries) of the parts that a task holds."""
    held, passing = defaultdict(list), []
    for b in batches:
        for p, kind, piece in zip(*(b.column(c).to_pylist() for c in ("part", "kind", "piece"))):
            if kind == SUMMARY:
                passing.append(_summary(json.loads(piece)))
            else:
                held[p, kind].append(piece)
    return held, passing


def _joined(pieces: list[bytes]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*(unpack(p) for p in pieces))]


def _packed(cols: list[np.ndarray]) -> np.ndarray:
    """A number for each row of numbers >= 0, in the order of the rows: columns side by side, or their ranks where 64 bits don't hold both."""
    ranks = lambda x: np.unique(x, return_inverse=True)[1].astype(np.uint64)
    bits = lambda x: int(x.max(initial=0)).bit_length()
    key, *rest = (c.astype(np.uint64) for c in cols)
    for c in rest:
        if bits(key) + bits(c) > 64:
            key = ranks(key)
        if bits(key) + bits(c) > 64:
            c = ranks(c)
        key = key << np.uint64(bits(c)) | c
    return key


def _summed(ids: list[np.ndarray], sums: list[np.ndarray], bits: int, key: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows of word numbers (below 2**bits) in order, with sums of the other columns; without any, with their count.

    key: hashes of the rows. Rows come in their order, or in that of their numbers if two rows share one.
    """
    n = len(ids[0])
    if key is None and not sums and bits * len(ids) <= 63:  # one number for a row, from which it is read again
        key = np.zeros(n, np.int64)
        for c in ids:
            key = key << bits | c.astype(np.int64)
        key = np.sort(key)
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:n])
        return [key[new] >> (bits * (len(ids) - 1 - k)) & ((1 << bits) - 1) for k in range(len(ids))], [np.diff(np.r_[new, n])]
    hashed = key is not None
    key = key if hashed else _packed(ids)
    order = np.argsort(key)
    key = key[order]
    differ = np.r_[True, key[1:] != key[:-1]][:n]
    if hashed:
        same = np.flatnonzero(~differ)
        if any((c[order[same]] != c[order[same - 1]]).any() for c in ids):
            return _summed(ids, sums, bits)
    new = np.flatnonzero(differ)
    ids = [c[order[new]].astype(np.int64) for c in ids]
    if not sums:
        return ids, [np.diff(np.r_[new, n])]
    return ids, [np.add.reduceat(c[order].astype(np.int64), new) if n else c.astype(np.int64) for c in sums]


def _dealt(df: DataFrame, bits: int, split: Callable) -> DataFrame:
    """Pieces at their parts (bits leading bits). Beyond HOP_BITS they go by their leading bits first, are put together there, and are dealt once more."""
    if bits > HOP_BITS:
        high = F.shiftright("part", bits - HOP_BITS)
        df = df.repartition(1 << bits, high, F.pmod(F.xxhash64("piece"), F.lit(1 << (bits - HOP_BITS)))).mapInArrow(trimmed(_regroup(split)), _PIECE)
    return df.repartition(1 << bits, "part")


def _regroup(split: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passing = _received(batches)
        yield from passing
        by_kind = defaultdict(list)
        for (_, kind), pieces in held.items():
            by_kind[kind] += pieces
        for kind, pieces in by_kind.items():
            for k in range(0, len(pieces), 1 << 14):
                yield from split(kind, _joined(pieces[k : k + (1 << 14)]))

    return run


def _word_pieces(bits: int) -> Callable:
    def split(kind: int, cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, n = added(cols[0], cols[1])
        yield from _pieces(kind, (keys >> np.uint64(64 - bits)).astype(np.int64), [keys, n])

    return split


def _row_pieces(keys: Keys, words: int, bits: int) -> Callable:
    """Pieces of rows of word numbers and sums. Pairs go by their key, triples (the last two words, then the first) by a hash of all three."""

    def split(kind: int, cols: list[np.ndarray], distinct: bool = False) -> Iterator[pa.RecordBatch]:
        ids, sums = (cols[:words], cols[words:]) if distinct else _summed(cols[:words], cols[words:], keys.bits)
        part = (keys.row(ids) >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int64)
        order = np.argsort(part, kind="stable")
        yield from _pieces(kind, part[order], [c[order] for c in (*ids, *sums)])

    return split


def _count_words(bits: int) -> Callable:
    split = _word_pieces(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, held = [], [], 0
        for _, texts in chunks(batches):
            distinct, at, _ = encode(texts)
            keys.append(distinct.astype(np.uint64) << np.uint64(1))
            n.append(np.bincount(at, minlength=len(distinct)))
            held += len(distinct)
            if held > 1 << 21:
                yield from split(WORDS, [np.concatenate(keys), np.concatenate(n)])
                keys, n, held = [], [], 0
        if keys:
            yield from split(WORDS, [np.concatenate(keys), np.concatenate(n)])

    return run


def _store_words(store: Store) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, _ = _received(batches)
        for (p, _), pieces in held.items():
            keys, n = added(*_joined(pieces))
            order = np.lexsort((keys, -n.astype(np.int64)))
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            store.put(f"word-{p}", keys)
            store.put(f"word-rank-{p}", rank)
            store.put_small(f"word-count-{p}", n[order])
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(n.sum())], pa.int64())], ["part", "size", "n"])

    return run


class Vocabulary:
    """Numbers of words by their hashes. END, START and any UNKNOWN word come first, then the most frequent word of each part, the second ones and so on."""

    END, START, UNKNOWN, FIRST = range(4)

    def __init__(self, store: Store, bits: int, sizes: list[int]):
        self.arrays = Arrays(store, "word", np.uint64, bits, 64, {"rank": np.uint32})
        self.parts, self.size, self.sizes = 1 << bits, sum(sizes), sizes
        top = self.FIRST + self.parts * max(sizes, default=0)
        if top >= 1 << 32:
            raise ValueError("more than 2**32 word numbers")
        self.keys = Keys(top.bit_length())

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        found = self.arrays.find(hashes.astype(np.uint64) << np.uint64(1))
        out = np.full(len(hashes), self.UNKNOWN, np.int64)
        hit = found >= 0
        out[hit] = self.FIRST + self.arrays.take("rank", found[hit]).astype(np.int64) * self.parts + (found[hit] >> Arrays.AT)
        return out

    def place(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(part, rank) of numbers; those that aren't words are in a part of their own."""
        word = ids >= self.FIRST
        return np.where(word, (ids - self.FIRST) % self.parts, self.parts), np.where(word, (ids - self.FIRST) // self.parts, ids)


def _count_grams(vocab: Vocabulary, order: int, bits: int) -> Callable:
    split = _row_pieces(vocab.keys, order, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches, 2 * CHUNK):
            distinct, at, sizes = encode(texts)
            # ranks of the numbers here: a row of them fits in one number, however large the vocabulary
            own, rank = np.unique(np.r_[vocab.numbers(distinct), vocab.START, vocab.END], return_inverse=True)
            cols = ngrams(rank[at], sizes, order, rank[-2], rank[-1])
            del texts, at
            ids, n = _summed([cols[-2], cols[-1], *cols[:-2]], [], len(own).bit_length())
            del cols
            yield from split(GRAMS if order == 3 else LEFTS, [*(own[c] for c in ids), *n], distinct=True)

    return run


def _tally(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def _store_grams(vocab: Vocabulary, store: Store, bits: int, pair_bits: int) -> Callable:
    """Stores the counts of triples; sends on pairs with a predecessor each (LEFTS) and pairs with their followers' counts (CONTEXTS)."""
    pairs = _row_pieces(vocab.keys, 2, pair_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passing = _received(batches)
        yield from passing
        for p, kind in list(held):
            *cols, n = _joined(held.pop((p, kind)))
            (second, third, first), (n,) = _summed(cols, [n], vocab.keys.bits, vocab.keys.row(cols))
            Hashed(store, "gram", bits).put(p, vocab.keys.row([second, third, first]), count=n)
            yield _summary({"part": p, "grams": _tally(n)})
            yield from pairs(LEFTS, [second, third])
            yield from pairs(CONTEXTS, [first, second, n, *((np.minimum(n, 3) == k).astype(np.int64) for k in (1, 2, 3))])

    return run


def _store_pairs(vocab: Vocabulary, store: Store, bits: int) -> Callable:
    """Stores pairs with their distinct predecessors (of order 2: their counts) and what follows them; sends on sums for their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passing = _received(batches)
        yield from passing
        none = [np.zeros(0, np.int64)] * 6
        for p in sorted({p for p, _ in held}):
            cols = _joined(held.pop((p, LEFTS), [])) or none[:3]
            (first, second), (left,) = _summed(cols[:2], cols[2:], vocab.keys.bits)
            cols = _joined(held.pop((p, CONTEXTS), [])) or none
            context, follow = _summed(cols[:2], cols[2:], vocab.keys.bits)
            key, other = vocab.keys.pair(first, second), vocab.keys.pair(*context)
            every, at = np.unique(np.r_[key, other], return_inverse=True)
            lefts, rows = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
            lefts[at[: len(key)]] = left
            # few different rows of what follows, the most frequent first: pairs keep their numbers, from 1 on
            alike = _packed(follow)
            order = np.argsort(alike)
            alike = alike[order]
            new = np.r_[True, alike[1:] != alike[:-1]][: len(order)]
            start = np.flatnonzero(new)
            often = np.argsort(-np.diff(np.r_[start, len(order)]), kind="stable")
            number = np.empty(len(start), np.int64)
            number[often] = np.arange(1, len(start) + 1)
            rows[at[len(key) :][order]] = number[np.cumsum(new) - 1]
            Hashed(store, "pair", bits).put(p, every, left=lefts, row=rows)
            store.put(f"pair-rows-{p}", np.concatenate([np.zeros((1, 4), np.int64), np.stack([f[order[start[often]]] for f in follow], 1)]))
            yield _summary({"part": p, "lefts": _tally(left)})
            ids, at = np.unique(np.concatenate([first, second]), return_inverse=True)
            at, after = at[: len(first)], at[len(first) :]
            kind = np.minimum(left, 3)
            sums = [np.bincount(at, left, len(ids)).astype(np.int64), *(np.bincount(at[kind == k], minlength=len(ids)) for k in (1, 2, 3))]
            sums.append(np.bincount(after, minlength=len(ids)))
            part, _ = vocab.place(ids)
            order = np.argsort(part, kind="stable")
            yield from _pieces(WORDS, part[order], [c[order] for c in (ids, *sums)])

    return run


_WORD = ("follow", "once", "twice", "more", "before")


def _store_stats(vocab: Vocabulary, store: Store) -> Callable:
    """Stores, for each word, the sum over its followers, how many of them count 1, 2 and more, and its distinct predecessors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passing = _received(batches)
        yield from passing
        for (p, _), pieces in held.items():
            cols = _joined(pieces)
            (ids,), sums = _summed(cols[:1], cols[1:], vocab.keys.bits)
            out = {"part": int(p), "before": _tally(sums[4]), "more": int((sums[4] >= 3).sum()), "types": int(sums[4].sum())}
            if p == vocab.parts:
                out["marks"] = {str(i): [int(s[k]) for s in sums] for k, i in enumerate(ids.tolist())}
            else:
                dense = np.zeros((len(_WORD), vocab.sizes[p]), np.int64)
                dense[:, vocab.place(ids)[1]] = sums
                store.put_small(f"word-stats-{p}", dense.ravel())
            yield _summary(out)

    return run


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """Of counts 0, 1, 2 and from 3 on. Where the counts of counts can't tell, a count loses half a unit."""
    d = np.array([0.0, 0.5, 0.5, 0.5])
    if n1 and n2:
        y = n1 / (n1 + 2 * n2)
        d[1] = 1 - 2 * y * n2 / n1
        d[2] = 2 - 3 * y * n3 / n2
        if n3:
            d[3] = 3 - 4 * y * n4 / n3
    return np.clip(d, [0, 0.05, 0.05, 0.05], [0, 0.95, 1.9, 2.9])


def _less(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    return n - d[np.minimum(n, 3).astype(np.int64)]


class Model:
    """Numbers of a trained model; the arrays stay in the shared folder."""

    def __init__(self, store: Store, vocab: Vocabulary, order: int, docs: int, tokens: int, bits: tuple[int, int], sums: list[dict]):
        add = lambda name: np.sum([s[name] for s in sums if name in s] or [[0] * 4], axis=0)
        self.store, self.vocab, self.order, self.docs, self.tokens = store, vocab, order, docs, tokens
        self.grams, self.pairs = Hashed(store, "gram", bits[0]), Hashed(store, "pair", bits[1])
        self.gram_d, self.pair_d, before = discounts(*add("grams")), discounts(*add("lefts")), add("before")
        self.word_d = discounts(*before)
        self.types = sum(s.get("types", 0) for s in sums)
        more = sum(s.get("more", 0) for s in sums)
        self.spread = float(self.word_d[1] * before[0] + self.word_d[2] * before[1] + self.word_d[3] * more) / self.types if self.types else 1.0
        self.marks = {int(k): v for s in sums for k, v in s.get("marks", {}).items()}

    @property
    def size(self) -> int:
        """Distinct training tokens, the end among them."""
        return self.vocab.size + (self.docs > 0)

    def _word_stats(self, ids: np.ndarray) -> dict[str, np.ndarray]:
        """count and the sums of _store_stats of word numbers, 0 for unknown ones."""
        out = {name: np.zeros(len(ids)) for name in ("count", *_WORD)}
        part, rank = self.vocab.place(ids)
        order = np.argsort(part)
        ranked = part[order]
        edges = np.r_[np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]), len(part)] if len(part) else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            p, mine = int(ranked[a]), order[a:b]
            if p < self.vocab.parts:
                out["count"][mine] = self.store.small(f"word-count-{p}")[rank[mine]]
                at = np.arange(len(_WORD))[:, None] * self.vocab.sizes[p] + rank[mine]
                for name, x in zip(_WORD, self.store.small(f"word-stats-{p}")[at.ravel()].reshape(at.shape)):
                    out[name][mine] = x
        for number in (self.vocab.START, self.vocab.END):
            at = ids == number
            out["count"][at] = self.docs
            for name, s in zip(_WORD, self.marks.get(number, [0] * 5)):
                out[name][at] = s
        return out

    def _followers(self, pairs: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Of each of the sorted pairs: the sum over its followers, and how many of them count 1, 2 and more."""
        out = np.zeros((len(pairs), 4))
        part = (pairs >> np.uint64(64 - self.pairs.bits)).astype(np.int64)
        edges = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)] if len(part) else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            if rows[a:b].any():
                out[a:b] = np.asarray(self.store.read(f"pair-rows-{part[a]}", np.int64)).reshape(-1, 4)[rows[a:b]]
        return out

    def score(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) of each text."""
        v = self.vocab
        distinct, at, sizes = encode(texts)
        # the local vocabulary: words, then end, then start
        ids = np.r_[v.numbers(distinct), v.END, v.START]
        cols = ngrams(at, sizes, self.order, len(distinct) + 1, len(distinct))
        mid, last = cols[-2], cols[-1]
        word = self._word_stats(ids)
        pair = v.keys.pair(ids[mid], ids[last])
        # the pair before a word is the one that the word before ends; before the first it is two starts
        keys, back = np.unique(np.r_[v.keys.pair(np.array([v.START]), np.array([v.START])), pair], return_inverse=True)
        edges = np.cumsum(sizes + 1) - (sizes + 1)
        context = back[:-1].copy()
        context[edges] = back[0]
        left, rows = self.pairs.look(keys, "left", "row")
        left = left[back[1:]].astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            low = np.maximum(_less(word["before"], self.word_d), 0) / self.types if self.types else np.zeros(len(ids))
            low = low + self.spread / (self.size + 1)
            down = word["once"] * self.pair_d[1] + word["twice"] * self.pair_d[2] + word["more"] * self.pair_d[3]
            p = np.where(word["follow"][mid] > 0, (_less(left, self.pair_d) + down[mid] * low[last]) / word["follow"][mid], low[last])
            if self.order == 3:
                grams, again = np.unique(Keys.triple(ids[cols[0]], pair), return_inverse=True)
                n = self.grams.look(grams, "count")[0][again].astype(np.float64)
                follow = self._followers(keys, rows)
                total, mass = follow[:, 0][context], (follow[:, 1:] @ self.gram_d[1:])[context]
                p = np.where(total > 0, (_less(n, self.gram_d) + mass * p) / total, p)
        base = np.log10((word["count"][last] + 0.5) / (self.tokens + 0.5 * (self.size + 1)))
        sums = lambda x: np.add.reduceat(x, edges) if len(x) else np.zeros(0)
        return sizes + 1, sums((word["count"][last] > 0).astype(np.int64)), sums(base), sums(np.log10(p))


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """A model of every text of docs. Null texts are empty documents; repeated rows count each; very long texts count whole; no rows give a model that spreads all evenly."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark = docs.sparkSession
    bounded_batches(spark)
    store = Store(f"{scratch(spark)}/docloom-lm-{uuid.uuid4().hex}")
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    n_docs, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    bits = part_bits(size // 12)  # words of a task are added up before they are dealt
    counted = _dealt(texts.mapInArrow(trimmed(_count_words(bits)), _PIECE), bits, _word_pieces(bits))
    parts = {r.part: (r["size"], r.n) for r in counted.mapInArrow(trimmed(_store_words(store)), "part int, size long, n long").collect()}  # one row per part
    vocab = Vocabulary(store, bits, [parts.get(p, (0, 0))[0] for p in range(1 << bits)])
    bits, pair_bits, word_bits = part_bits(size // 6), part_bits(size // 4), bits
    first = texts.mapInArrow(trimmed(_count_grams(vocab, order, bits if order == 3 else pair_bits)), _PIECE)
    if order == 3:
        first = _dealt(first, bits, _row_pieces(vocab.keys, 3, bits)).mapInArrow(trimmed(_store_grams(vocab, store, bits, pair_bits)), _PIECE)
    pairs = _dealt(first, pair_bits, _row_pieces(vocab.keys, 2, pair_bits)).mapInArrow(trimmed(_store_pairs(vocab, store, pair_bits)), _PIECE)
    last = pairs.repartition((1 << word_bits) + 1, "part").mapInArrow(trimmed(_store_stats(vocab, store)), _PIECE)
    sums = [json.loads(bytes(r.piece)) for r in last.select("piece").collect()]  # a few rows per part
    return Model(store, vocab, order, n_docs, sum(n for _, n in parts.values()) + n_docs, (bits, pair_bits), sums)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of the whole text and its end).

    A null text is an empty one: its end alone is scored. Very long texts are scored whole. Columns of docs with those names
    are replaced; repeated rows are scored each; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    new = [("n_tokens", pa.int64(), T.LongType()), ("n_known", pa.int64(), T.LongType()), ("train_tokens", pa.int64(), T.LongType()), ("base_score", pa.float64(), T.DoubleType()), ("score", pa.float64(), T.DoubleType())]
    names = [n for n, _, _ in new]
    cols = [c for c in docs.columns if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, texts in chunks(batches):
            n, known, base, mine = model.score(texts)
            del texts
            full = (n, known, np.full(len(n), model.tokens), base, mine)
            at = 0
            for b in held:
                s = slice(at, at + b.num_rows)
                at += b.num_rows
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), *(pa.array(x[s], t) for x, (_, t, _) in zip(full, new))], [*cols, *names])

    schema = T.StructType([*(docs.schema[c] for c in cols), *(T.StructField(n, t) for n, _, t in new)])
    return docs.select(*cols).mapInArrow(trimmed(run), schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every whole text, learnt from four folds of five."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs.where(fold("doc_id", FOLDS) != HELD_OUT)))
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
