"""Exact substring dedup over all documents by sparse suffix arrays with deep-shallow sorting.

Every LENGTH-byte string (window) has one anchor: the leftmost of its GRAM-byte grams with the least hash. Equal windows
have equal grams at the same offset, so only occurrences of one gram need comparing, and windows of one anchor are a run.

1. Anchors are hashed; hashes that occur twice or more are kept as sorted arrays in the shared folder.
2. Anchors with such a hash give their context, the text that their run of windows covers. Equal contexts become one
   class with the place of its first occurrence, by an aggregation with map-side combine.
3. The run of a class is cut into at most BANDS bands of windows that begin within BAND bytes of each other. All windows of
   a band share their middle LENGTH - BAND + 1 bytes, the band's key. Within each key the bands' texts from the key on
   and before it are put in suffix order by deep-shallow sorting: multikey quicksort on 8-byte characters to SHALLOW
   bytes, then a blind trie for each group of strings still equal. Common prefixes of neighbours say which windows of a
   band occur in an earlier one. Every class takes this path, and gives the same few rows however many share its gram;
   under one key lie as many different strings as there are different BAND - 1 bytes on either side of it.
4. A last pass over the texts looks up each anchor's class and cuts its repeated windows. Texts are never shuffled.

Hashes decide nothing alone: grams and keys only bring strings together, which are then compared; classes and bands are
told apart by 127 bits.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import bounded_batches, discard, materialise, scratch, table
from docloom.llm.sorted_arrays import Arrays, Store, added, emit, gather, part_bits, store_arrays

LENGTH = 100
#: Grams of LENGTH - 63 bytes leave 64 places in a window, one bit each.
PLACES = 64
GRAM = LENGTH - PLACES + 1
#: Windows of a band begin at so many places; a run of windows touches so many bands at most.
BAND = 8
BANDS = PLACES // BAND
SHALLOW = 64
#: Bytes that are searched for anchors at a time.
PIECE = 1 << 20
#: Anchors or classes of a part of the arrays, about; a task may hold several parts.
PART = 300_000
_LAST = np.int64((1 << 63) - 1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def name_of(string: bytes, kind: int) -> tuple[int, int]:
    """63 and 64 bits that tell strings of a kind apart; the first are the place in the arrays, the others are compared there."""
    digest = xxhash.xxh3_128_intdigest(string, kind)
    return digest >> 65, (digest & ((1 << 64) - 1)) - (1 << 63)


class Piece:
    """Some texts (or a stretch of a long one) in one buffer, with their anchors."""

    def __init__(self, data: bytes, text: np.ndarray, offset: np.ndarray, starts: np.ndarray):
        """text: number of each stretch's text; offset: where in the text it begins; starts: where in data."""
        self.data, self.text, self.offset, self.starts = data, text, offset, starts
        n = len(data)
        self.at = self.first = self.last = np.zeros(0, np.int64)
        self.hash = np.zeros(0, np.uint64)
        if n < LENGTH:
            return
        raw = np.frombuffer(data + b"\0" * 8, np.uint8)
        word = np.empty(n, np.uint64)
        for k in range(8):
            part = raw[k : k + (n - k + 7) // 8 * 8].view("<u8") if k < n else raw[:0].view("<u8")
            word[k::8] = part[: len(word[k::8])]
        m = n - GRAM + 1
        h = word[:m] * _A
        for j in (8, 16, 24, GRAM - 8):
            h = (h ^ (h >> np.uint64(29))) * _A + word[j : j + m] * _B
        h = (h ^ (h >> np.uint64(32))) * _A
        h ^= h >> np.uint64(29)
        bits = np.uint64(int(m).bit_length())
        low = (h >> bits << bits) | np.arange(m, dtype=np.uint64)
        step = 1
        while step < PLACES:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        where = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)  # the anchor of the window at each place
        stretch = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
        inside = stretch[: len(where)] == stretch[LENGTH - 1 : LENGTH - 1 + len(where)]
        where = np.where(inside, where, -1)
        turn = np.flatnonzero(np.r_[True, (where[1:] != where[:-1])])
        end = np.r_[turn[1:], len(where)] - 1
        keep = where[turn] >= 0
        self.first, self.last = turn[keep], end[keep]  # places of the first and last window of each run
        self.at = where[turn][keep]
        # anchors have the least hashes, so that their leading bits are alike: mixed again before they are dealt by them
        again = h[self.at] * _B
        self.hash = (again ^ (again >> np.uint64(32))) * _A
        self.stretch = stretch[self.at]

    def context(self, i: int) -> bytes:
        return self.data[self.first[i] : self.last[i] + LENGTH]

    def class_of(self, i: int) -> tuple[int, int]:
        """Name of a context and of where its anchor lies in it."""
        return name_of(self.context(i), int(self.at[i] - self.first[i]))


def pieces(texts: list[bytes]) -> Iterator[Piece]:
    """All windows of all texts, each in one piece."""
    data, text, offset, starts, size = [], [], [], [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), PIECE):
            part = t[at : at + PIECE + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if size and size + len(part) > PIECE:
                yield Piece(b"".join(data), np.array(text), np.array(offset), np.array(starts))
                data, text, offset, starts, size = [], [], [], [], 0
            data.append(part)
            text.append(k)
            offset.append(at)
            starts.append(size)
            size += len(part)
    if size:
        yield Piece(b"".join(data), np.array(text), np.array(offset), np.array(starts))


def _texts(b: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in b.column("text").to_pylist()]


def _count_anchors(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(_texts(b)):
                keys, n = added(p.hash, np.ones(len(p.hash), np.int64))
                yield from emit((keys >> np.uint64(64 - bits)).astype(np.int64), keys, n)

    return run


def _store_repeated(store: Store) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, keys, n in gather(batches, np.uint64):
            keys = keys[n > 1]
            store.put(f"gram-{p}", keys)
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32())], ["part"])

    return run


def _repeated(p: Piece, grams: Arrays) -> np.ndarray:
    """Anchors of a piece whose gram occurs elsewhere too."""
    distinct, back = np.unique(p.hash, return_inverse=True)
    return np.flatnonzero((grams.find(distinct) >= 0)[back])


_PLACE = ("doc", "tie", "pos")
_CONTEXT = "class long, twin long, gram long, doc long, tie long, pos long, before int, context binary, n long"


def _rows(names: str, columns: list) -> pa.RecordBatch:
    """A batch of lists whose names and types are those of a DDL schema."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _contexts(grams: Arrays) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, doc, tie = _texts(b), b.column("doc").to_pylist(), b.column("tie").to_pylist()
            found: dict[tuple[int, int], list] = {}  # the first of each class in the batch, with its count
            for p in pieces(texts):
                for i in _repeated(p, grams).tolist():
                    s = p.stretch[i]
                    k = p.text[s]
                    place = (doc[k], tie[k], int(p.at[i] - p.starts[s] + p.offset[s]))
                    c = p.class_of(i)
                    if c not in found:
                        found[c] = [place, p.hash[i].astype(np.int64), int(p.at[i] - p.first[i]), p.context(i), 1]
                    else:
                        found[c][4] += 1
                        found[c][0] = min(found[c][0], place)
            rows = list(found.items())
            for at in range(0, len(rows), 20_000):
                part = rows[at : at + 20_000]
                yield _rows(_CONTEXT, [
                    [c[0] for c, _ in part], [c[1] for c, _ in part], [int(v[1]) for _, v in part], *([v[0][k] for _, v in part] for k in range(3)),
                    [v[2] for _, v in part], [v[3] for _, v in part], [v[4] for _, v in part],
                ])

    return run


class BlindTrie:
    """Order of byte strings that share their first bytes: a trie that stores branching depths and one byte per branch."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | int | None = None  # a node: [depth, {byte: node or leaf}]; a leaf: its strings' first number
        self.same: dict[int, list[int]] = {}
        for i in range(len(strings)):
            self._insert(i)

    def _byte(self, i: int, depth: int) -> int:
        s = self.strings[i]
        return s[depth] if depth < len(s) else -1

    def _insert(self, i: int) -> None:
        if self.root is None:
            self.root = i
            return
        node = self.root
        while not isinstance(node, int):  # blindly: bytes between branchings aren't looked at
            child = node[1].get(self._byte(i, node[0]))
            node = child if child is not None else next(iter(node[1].values()))
        a, b = self.strings[i], self.strings[node]
        if a == b:
            self.same.setdefault(node, []).append(i)
            return
        n = min(len(a), len(b))
        x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
        depth = n - (x.bit_length() + 7) // 8 if x else n  # the common prefix
        mine, theirs = self._byte(i, depth), self._byte(node, depth)
        parent, edge, node = None, None, self.root
        while not isinstance(node, int) and node[0] < depth:
            parent, edge = node, self._byte(i, node[0])
            node = node[1][edge]
        if not isinstance(node, int) and node[0] == depth:
            node[1][mine] = i
            return
        new = [depth, {theirs: node, mine: i}]
        if parent is None:
            self.root = new
        else:
            parent[1][edge] = new

    def order(self) -> list[int]:
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, int):
                out += [node, *self.same.get(node, ())]
            else:
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]
        return out


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each stretch, one after the other."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)


def multikey_quicksort(table: np.ndarray, order: np.ndarray, begin: np.ndarray, end: np.ndarray, depths: int) -> np.ndarray:
    """Sorts the rows order[begin:end] of each stretch by their first depths characters, in place. Returns where rows differ from the one before.

    Every round splits all stretches at once: each by a pivot, the median of three of its characters at its depth, into
    smaller, equal and larger; equal ones go on one character deeper.
    """
    fresh = np.zeros(len(order), bool)
    fresh[begin] = True
    depth = np.zeros(len(begin), np.int64)
    while True:
        live = (end - begin > 1) & (depth < depths)
        begin, end, depth = begin[live], end[live], depth[live]
        if not len(begin):
            return fresh
        size = end - begin
        at = _spread(begin, size)
        owner = np.repeat(np.arange(len(begin)), size)
        char = table[order[at], depth[owner]]
        starts = np.cumsum(size) - size
        three = np.sort(np.stack([char[starts], char[starts + size // 2], char[starts + size - 1]]), axis=0)
        pivot = three[1][owner]
        side = (char > pivot).astype(np.int64) + (char >= pivot)
        counts = np.bincount(owner * 3 + side, minlength=3 * len(begin)).reshape(-1, 3)
        low = begin[:, None] + np.cumsum(counts, axis=1) - counts
        to = np.empty(len(at), np.int64)
        for k in range(3):
            mine = np.flatnonzero(side == k)
            own = owner[mine]
            to[mine] = low[own, k] + np.arange(len(mine)) - (np.cumsum(counts[:, k]) - counts[:, k])[own]
        order[to] = order[at].copy()
        begin, end = low.ravel(), (low + counts).ravel()
        fresh[begin[end > begin]] = True
        depth = (depth[:, None] + np.array([0, 1, 0])).ravel()


def deep_shallow(strings: list[bytes], group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common) of strings of width bytes at most, sorted within sorted groups; common prefix with the one before, -1 where a group begins.

    Shorter strings count as padded by zero bytes.
    """
    n, wide = len(strings), -(-width // 8) * 8
    table = np.frombuffer(b"".join(s.ljust(wide, b"\0") for s in strings), ">u8").reshape(n, wide // 8).astype(np.uint64) if n else np.zeros((0, wide // 8), np.uint64)
    order = np.argsort(group, kind="stable")
    edge = np.r_[np.flatnonzero(np.r_[True, np.diff(group[order]) != 0][:n]), n]
    fresh = multikey_quicksort(table, order, edge[:-1], edge[1:], min(SHALLOW, wide) // 8)
    edge = np.r_[np.flatnonzero(fresh), n]
    for k in np.flatnonzero(np.diff(edge) > 1) if wide > SHALLOW else ():
        mine = order[edge[k] : edge[k + 1]]
        rest = [strings[i].ljust(wide, b"\0")[SHALLOW:] for i in mine]
        order[edge[k] : edge[k + 1]] = mine[BlindTrie(rest).order()]
    raw = table.astype(">u8").view(np.uint8).reshape(n, wide)[order]
    common = np.full(n, -1, np.int64)
    if n > 1:
        differ = raw[1:] != raw[:-1]
        common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
        common[1:][np.diff(group[order]) != 0] = -1
    return order, common


def repeated_windows(gram: np.ndarray, place: np.ndarray, before: np.ndarray, contexts: list[bytes]) -> np.ndarray:
    """For each string, the bits of the windows that an earlier string of its group has too. Bit a: the window that begins a bytes before the anchor, a < BAND.

    place: rank of each string's first occurrence. before: bytes before the anchor.
    """
    n = len(contexts)
    length = np.array([len(c) for c in contexts])
    after = [c[b:] for c, b in zip(contexts, before)]
    back = [c[:b][::-1] for c, b in zip(contexts, before)]
    classes = []
    for strings, width in ((after, LENGTH), (back, BAND)):
        order, common = deep_shallow(strings, gram, width)
        classes.append((order, common))
    least = before - (length - LENGTH)  # the last window's distance to the anchor
    bits = np.zeros(n, np.uint64)
    wide = int(max(1, n)).bit_length()

    def class_at(k: int, depth: int) -> np.ndarray:
        order, common = classes[k]
        out = np.empty(n, np.int64)
        out[order] = np.cumsum(common < depth)
        return out

    for a in range(BAND):
        rows = np.flatnonzero((least <= a) & (a <= before))
        if len(rows) < 2:
            continue
        key = class_at(1, a)[rows] << wide | class_at(0, LENGTH - a)[rows]
        o = np.lexsort((place[rows], key))
        again = np.flatnonzero(np.r_[False, key[o][1:] == key[o][:-1]])
        bits[rows[o[again]]] |= np.uint64(1 << a)
    return bits


def bands_of(context: bytes, before: int) -> Iterator[tuple[int, int, bytes]]:
    """(band, bytes before the key, text) of each band that a context's run touches. Window a of the context is window a - BAND * band of the band."""
    least = before - (len(context) - LENGTH)
    for band in range(least // BAND, before // BAND + 1):
        high, low = min(before, BAND * band + BAND - 1), max(least, BAND * band)
        yield band, high - BAND * band, context[before - high : before - low + LENGTH]


_BAND_ROW = "key long, name long, twin long, band int, before int, string binary, doc long, tie long, pos long, several int"


def _band_rows(rivals: Arrays) -> Callable:
    """A row for each band of the classes that share their gram with others; those with equal texts are one row a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[tuple, list] = {}
            rows = _with_rivals(b, rivals)
            for place, before, context in zip(zip(*(rows.column(c).to_pylist() for c in _PLACE)), rows.column("before").to_pylist(), rows.column("context").to_pylist()):
                for band, ahead, text in bands_of(context, before):
                    have = found.setdefault((band, ahead, text), [place, 0])
                    have[0] = min(have[0], place)
                    have[1] += 1
            rows = list(found.items())
            for at in range(0, len(rows), 20_000):
                part = rows[at : at + 20_000]
                names = [name_of(text, BAND * band + ahead) for (band, ahead, text), _ in part]
                keys = [xxhash.xxh3_64_intdigest(text[ahead : ahead + LENGTH - BAND + 1], band) >> 1 for (band, ahead, text), _ in part]
                yield _rows(_BAND_ROW, [
                    keys, [n for n, _ in names], [t for _, t in names], *([k[j] for k, _ in part] for j in range(3)),
                    *([v[0][j] for _, v in part] for j in range(3)), [int(v[1] > 1) for _, v in part],
                ])

    return run


def _with_rivals(b: pa.RecordBatch, rivals: Arrays) -> pa.RecordBatch:
    distinct, back = np.unique(b.column("gram").to_numpy().view(np.uint64), return_inverse=True)
    return b.filter(pa.array((rivals.find(distinct) >= 0)[back]))


def _sort_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, twin, bits, doc, tie, pos) of the bands' texts that several classes have or whose windows an earlier one has. Rows come sorted by key, then text and place; chunks are cut between keys."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        cols = {c: t.column(c).to_numpy() for c in ("key", "name", "twin", "before", "doc", "tie", "pos", "several")}
        new = np.r_[True, (np.diff(cols["key"]) != 0) | (np.diff(cols["name"]) != 0) | (np.diff(cols["twin"]) != 0)]
        first = np.flatnonzero(new)  # rows of one text are side by side, the first place first
        several = np.add.reduceat(cols["several"], first) + np.diff(np.r_[first, len(new)]) > 1
        cols = {c: v[first] for c, v in cols.items()}
        texts = t.column("string").take(pa.array(first)).to_pylist()
        place = np.empty(len(first), np.int64)
        place[np.lexsort((cols["pos"], cols["tie"], cols["doc"]))] = np.arange(len(place))
        bits = repeated_windows(cols["key"], place, cols["before"].astype(np.int64), texts).view(np.int64)
        keep = np.flatnonzero(several | (bits != 0))
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (cols["name"], cols["twin"], bits, *(cols[c] for c in _PLACE))], ["name", "twin", "bits", *_PLACE])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= 50_000:
            t = pa.Table.from_batches(held)
            key = t.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if cut:
                yield solve(t.slice(0, cut))
            held, n = t.slice(cut).to_batches(), t.num_rows - cut
    if n:
        yield solve(pa.Table.from_batches(held))


def _class_bits(rivals: Arrays, texts: Arrays) -> Callable:
    """(class, twin, bits, doc, tie, pos) of the classes that occur several times or have windows that an earlier class has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.append_column("row", pa.array(np.arange(b.num_rows)))
            some = _with_rivals(b, rivals)
            owner, names, twins, band, spans = [], [], [], [], []
            for row, before, context in zip(some.column("row").to_pylist(), some.column("before").to_pylist(), some.column("context").to_pylist()):
                for k, ahead, text in bands_of(context, before):
                    name, twin = name_of(text, BAND * k + ahead)
                    owner.append(row)
                    names.append(name)
                    twins.append(twin)
                    band.append(k)
                    low = ahead - (len(text) - LENGTH)
                    spans.append((1 << (ahead + 1)) - (1 << low))
            bits = np.zeros(b.num_rows, np.uint64)
            if owner:
                owner, band, all_of = np.array(owner), np.array(band), np.array(spans, np.uint64)
                number = texts.find(np.array(names, np.int64), np.array(twins, np.int64))
                hit = np.flatnonzero(number >= 0)
                place = [b.column(c).to_numpy()[owner[hit]] for c in _PLACE]
                here = np.logical_and.reduce([texts.take(c, number[hit]) == x for c, x in zip(_PLACE, place)])
                mine = np.where(here, texts.take("bits", number[hit]).view(np.uint64), all_of[hit])  # a text that began elsewhere: all its windows
                np.bitwise_or.at(bits, owner[hit], mine << (BAND * band[hit]).astype(np.uint64))
            keep = pa.array((bits != 0) | (b.column("n").to_numpy() > 1))
            out = [b.column("class"), b.column("twin"), pa.array(bits.view(np.int64)), *(b.column(c) for c in _PLACE)]
            yield pa.RecordBatch.from_arrays(out, ["name", "twin", "bits", *_PLACE]).filter(keep)

    return run


_NAMED = ("twin", "bits", *_PLACE)


def _store_named(store: Store, name: str, bits: int) -> Callable:
    """Stores rows (name, twin, bits, place) sorted by name and twin; dealt by the leading bits of name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[b.column(c).to_numpy() for c in ("name", *_NAMED)] for b in batches if b.num_rows]
        if held:
            cols = [np.concatenate(x) for x in zip(*held)]
            order = np.lexsort((cols[1], cols[0]))
            cols = [c[order] for c in cols]
            part = cols[0] >> (63 - bits)
            for p in np.unique(part):
                for c, x in zip(("", *(f"-{k}" for k in _NAMED)), cols):
                    store.put(f"{name}{c}-{p}", x[part == p])
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32())], ["part"])

    return run


def _stored(rows: DataFrame, store: Store, name: str, bits: int) -> Arrays:
    dealt = rows.repartition(1 << bits, F.shiftright("name", 63 - bits))
    dealt.mapInArrow(_store_named(store, name, bits), "part int").agg(F.count("*")).collect()
    return Arrays(store, name, np.int64, bits, 63, {k: np.int64 for k in _NAMED})


def _cut(grams: Arrays, classes: Arrays, keep_text: bool, cols: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _texts(b)
            doc, tie = b.column("doc").to_numpy(), b.column("tie").to_numpy()
            edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])  # a gap of one byte between texts
            marks = np.zeros(int(edges[-1]) + 1, np.int32)
            for p in pieces(texts):
                some = _repeated(p, grams)
                names = np.array([p.class_of(i) for i in some.tolist()], np.int64).reshape(-1, 2)
                number = classes.find(names[:, 0], names[:, 1])
                some, number = some[number >= 0], number[number >= 0]
                s = p.stretch[some]
                text, inside = p.text[s], p.offset[s] - p.starts[s]
                at, shift = p.at[some], edges[text] + inside
                here = classes.take("doc", number) == doc[text]
                here &= (classes.take("tie", number) == tie[text]) & (classes.take("pos", number) == at + inside)
                later = ~here  # the class began elsewhere: all its windows go
                np.add.at(marks, (p.first[some] + shift)[later], 1)
                np.add.at(marks, (p.last[some] + shift)[later] + LENGTH, -1)
                bits = np.where(here, classes.take("bits", number).view(np.uint64), 0)
                rows = np.flatnonzero(bits)
                for a in range(PLACES):
                    mine = rows[(bits[rows] >> np.uint64(a) & np.uint64(1)) == 1]
                    np.add.at(marks, at[mine] - a + shift[mine], 1)
                    np.add.at(marks, at[mine] - a + LENGTH + shift[mine], -1)
            gone = np.cumsum(marks) > 0
            out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
            for k, t in enumerate(texts):
                g = gone[edges[k] : edges[k] + len(t)]
                step = np.diff(np.r_[False, g, False].astype(np.int8))
                begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                rest = np.frombuffer(t, np.uint8)[~g].tobytes() if len(begin) else t
                out["n_bytes"].append(len(t))
                out["n_removed"].append(len(t) - len(rest))
                out["n_spans"].append(len(begin))
                out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
                out["spans"].append([{"start": int(x), "stop": int(y)} for x, y in zip(begin, end)])
                out["kept"].append(rest if keep_text else None)
            kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), *(pa.array(out[c], t) for c, t in zip(out, kinds))], [*cols, *out])

    return run


def remove_repeats(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte ranges) and kept (the bytes that stay; null without keep_text).

    A byte goes if a string of LENGTH bytes over it also starts earlier: in a smaller doc_id, or further left in the same
    document. A null text is empty; texts shorter than LENGTH stay whole; very long ones are searched PIECE bytes at a
    time, which changes nothing in the result. A null doc_id is the largest. Rows with one doc_id and different texts are
    ordered by a hash of the text; rows that repeat both get equal results, as if each were the only one. Columns of docs
    with those names, or doc, tie, are replaced. An empty table gives no rows. kept is bytes, as a cut can fall inside a
    character.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
    cols = [c for c in docs.columns if c not in (*new, "doc", "tie")]
    bare = [c for c in cols if c != "text"]
    raw = docs.select(*bare, F.col("text").cast("binary").alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(int(_LAST))).alias("doc"), F.xxhash64("text").alias("tie"))
    store = Store(f"{scratch(spark)}/docloom-repeats-{uuid.uuid4().hex}")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = part_bits(size // (PLACES // 2), PART)
    counted = raw.select("text").mapInArrow(_count_anchors(bits), "part int, key long, n long").repartition(1 << bits, "part")
    counted.mapInArrow(_store_repeated(store), "part int").agg(F.count("*")).collect()
    grams = Arrays(store, "gram", np.uint64, bits, 64)
    found = raw.select("doc", "tie", "text").mapInArrow(_contexts(grams), _CONTEXT)
    first = found.groupBy("class", "twin").agg(F.min(F.struct(*_PLACE)).alias("place"), F.sum("n").alias("n"), F.first("gram").alias("gram"), F.first("before").alias("before"), F.first("context").alias("context"))
    classes = materialise(first.select("class", "twin", "place.*", "n", "gram", "before", "context"), "contexts")
    bits = part_bits(size // PLACES, PART)
    shared = classes.groupBy("gram").agg(F.count("*").alias("members")).where("members > 1")
    rivals = store_arrays(shared.select("gram"), store.root, "rival", size // PLACES)
    bands = classes.mapInArrow(_band_rows(rivals), _BAND_ROW).repartition("key").sortWithinPartitions("key", "name", "twin", *_PLACE)
    named = f"name long, twin long, bits long, {', '.join(f'{c} long' for c in _PLACE)}"
    texts = _stored(bands.mapInArrow(_sort_bands, named), store, "band", bits)
    index = _stored(classes.mapInArrow(_class_bits(rivals, texts), named), store, "class", bits)
    discard(classes)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    kinds = [T.LongType()] * 3 + [T.StringType(), span, T.BinaryType()]
    schema = T.StructType([*(docs.schema[c] for c in bare), *(T.StructField(c, t) for c, t in zip(new, kinds))])
    cut = raw.mapInArrow(_cut(grams, index, keep_text, bare), schema)
    return cut


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that stay of every whole text."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
