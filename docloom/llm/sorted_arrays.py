"""Sorted arrays of 64-bit keys in the shared folder: written by tasks part by part, memory-mapped by others."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import trimmed

#: Entries of a part before equal ones are added up, about.
PART_ENTRIES = 1_500_000


class Store:
    """Arrays by name in the shared folder. Workers map those of a file system; of other stores they read the parts that they ask for."""

    def __init__(self, root: str):
        self.root = root

    def _local(self) -> str | None:
        parsed = urlparse(self.root)
        return parsed.path if parsed.scheme in ("", "file") else None

    def put(self, name: str, array: np.ndarray) -> None:
        data = np.ascontiguousarray(array)
        if (local := self._local()) is not None:
            os.makedirs(local, exist_ok=True)
            part = f"{local}/.{name}-{uuid.uuid4().hex}"
            data.tofile(part)
            os.replace(part, f"{local}/{name}")
        else:
            from pyarrow import fs

            system, path = fs.FileSystem.from_uri(self.root)
            with system.open_output_stream(f"{path}/{name}") as out:
                out.write(data.tobytes())

    def read(self, name: str, dtype) -> np.ndarray:
        """A whole array, mapped where the folder is a file system; empty if it isn't there."""
        if (local := self._local()) is not None:
            path = f"{local}/{name}"
            return np.memmap(path, dtype, "r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, dtype)
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.root)
        if system.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
            return np.zeros(0, dtype)
        with system.open_input_stream(f"{path}/{name}") as src:
            return np.frombuffer(src.read(), dtype)

    def put_small(self, name: str, a: np.ndarray) -> None:
        """Numbers >= 0, most of them small: a byte each, and the few from 255 on apart."""
        self.put(name, np.minimum(a, 255).astype(np.uint8))
        large = np.flatnonzero(a >= 255)
        if len(large):
            self.put(f"{name}-large", np.r_[large, a[large]].astype(np.int64))

    def small(self, name: str) -> "Small":
        large = np.asarray(self.read(f"{name}-large", np.int64))  # plain arrays: slices of numpy's own kind of map cost more than what is read
        return Small(np.asarray(self.read(name, np.uint8)), large[: len(large) // 2], large[len(large) // 2 :])


class Small:
    """Numbers that put_small() wrote; zeros if they aren't there."""

    def __init__(self, low: np.ndarray, at: np.ndarray, large: np.ndarray):
        self.low, self.at, self.large = low, at, large

    def __getitem__(self, k: np.ndarray) -> np.ndarray:
        if not len(self.low):
            return np.zeros(len(k), np.int64)
        out = self.low[k].astype(np.int64)
        big = np.flatnonzero(out == 255)
        if len(big):
            out[big] = self.large[np.searchsorted(self.at, k[big])]
        return out


def pack(keys: np.ndarray, *cols: np.ndarray) -> bytes:
    """Sorted keys and other columns of numbers >= 0, packed: differences of keys, bytes of equal weight together, compressed."""
    out = []
    for k, c in enumerate((keys, *cols)):
        c = c.astype(np.uint64)
        c = np.diff(c, prepend=np.uint64(0)) if k == 0 else c
        width = max(1, (int(c.max(initial=0)).bit_length() + 7) // 8)
        planes = c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
        small = pa.compress(planes, codec="zstd", asbytes=True)
        out.append(b"%d %d %d %d " % (len(c), width, len(small), 0) + small)
    return b"".join(out)


def unpack(piece: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(piece):
        n, width, size, _, _ = piece[at : at + 80].split(b" ", 4)
        n, width, size = int(n), int(width), int(size)
        at += len(b"%d %d %d 0 " % (n, width, size))
        planes = np.frombuffer(pa.decompress(piece[at : at + size], n * width, codec="zstd"), np.uint8).reshape(width, n)
        at += size
        c = np.zeros((n, 8), np.uint8)
        c[:, :width] = planes.T
        c = c.view("<u8").ravel()
        out.append(np.cumsum(c, dtype=np.uint64) if not out else c)
    return out


class Arrays:
    """Sorted keys in parts by their leading bits, one file a part, and values stored alike. Tasks open the parts that they ask for, OPEN at a time."""

    OPEN, AT = 4096, 40

    def __init__(self, store: Store, name: str, dtype, bits: int, width: int, kinds: dict | None = None):
        self.store, self.name, self.bits, self.width = store, name, bits, width
        self.kinds = {"": dtype, **(kinds or {})}
        self.parts: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"parts": {}}

    def part(self, p: int, value: str = "") -> np.ndarray:
        have = self.parts.get((value, p))
        if have is None:
            if len(self.parts) >= self.OPEN:
                self.parts.pop(next(iter(self.parts)))
            have = self.parts[value, p] = self.store.read(f"{self.name}{value and f'-{value}'}-{p}", self.kinds[value])
        return have

    def find(self, keys: np.ndarray, twins: np.ndarray | None = None) -> np.ndarray:
        """Number of each key (whose value twin is its own in twins), -1 for those that aren't there. Keys in any order."""
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        found = np.full(len(keys), -1, np.int64)
        part = (ranked >> ranked.dtype.type(self.width - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        edges = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)] if len(part) else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            p = int(part[a])
            have = self.part(p)
            if not len(have):
                continue
            mine = ranked[a:b]
            at = np.searchsorted(have, mine)
            hit = have[np.minimum(at, len(have) - 1)] == mine
            hit &= at < len(have)
            if twins is not None:  # keys that are equal by chance lie side by side
                theirs, own = self.part(p, "twin"), twins[order[a:b]]
                while True:
                    wrong = np.flatnonzero(hit)
                    wrong = wrong[theirs[at[wrong]] != own[wrong]]
                    if not len(wrong):
                        break
                    at[wrong] += 1
                    hit[wrong] = (at[wrong] < len(have)) & (have[np.minimum(at[wrong], len(have) - 1)] == mine[wrong])
            found[order[a:b]] = np.where(hit, at + (p << self.AT), -1)
        return found

    def spans(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, how many) of the entries of each key; keys in any order, entries of one key are numbered in turn."""
        first, count = self.find(keys), np.zeros(len(keys), np.int64)
        for p in np.unique(first[first >= 0] >> self.AT).tolist():
            mine = np.flatnonzero((first >= 0) & (first >> self.AT == p))
            count[mine] = np.searchsorted(self.part(p), keys[mine], side="right") - (first[mine] & ((1 << self.AT) - 1))
        return first, count

    def take(self, value: str, numbers: np.ndarray) -> np.ndarray:
        """Values of numbers that are there, in any order."""
        order = np.argsort(numbers, kind="stable")
        ranked = numbers[order]
        out = np.zeros(len(numbers), self.kinds[value])
        part = ranked >> self.AT
        edges = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)] if len(part) else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            out[order[a:b]] = self.part(int(part[a]), value)[ranked[a:b] & ((1 << self.AT) - 1)]
        return out


class Hashed:
    """Small values by 64-bit hashes, in parts by their leading bits. A part keeps a table of where each run of next bits begins, about 16 entries each, and 32 bits more of each hash, sorted."""

    OPEN = 1024

    def __init__(self, store: Store, name: str, bits: int):
        self.store, self.name, self.bits = store, name, bits
        self.parts: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"parts": {}}

    def _cut(self, keys: np.ndarray, runs: int) -> tuple[np.ndarray, np.ndarray]:
        rest = keys << np.uint64(self.bits)
        run = (rest >> np.uint64(64 - runs)).astype(np.int64) if runs else np.zeros(len(keys), np.int64)
        return run, (rest << np.uint64(runs) >> np.uint64(32)).astype(np.uint32)

    def put(self, p: int, keys: np.ndarray, **values: np.ndarray) -> None:
        """Stores one part; keys are distinct."""
        order = np.argsort(keys)
        runs = max(0, int(len(keys)).bit_length() - 5)
        run, rest = self._cut(keys[order], runs)
        self.store.put(f"{self.name}-{p}", rest)
        self.store.put(f"{self.name}-runs-{p}", np.searchsorted(run, np.arange((1 << runs) + 1)).astype(np.uint32))
        for name, x in values.items():
            self.store.put_small(f"{self.name}-{name}-{p}", x[order])

    def _part(self, p: int) -> tuple:
        have = self.parts.get(p)
        if have is None:
            if len(self.parts) >= self.OPEN:
                self.parts.pop(next(iter(self.parts)))
            have = self.parts[p] = (np.asarray(self.store.read(f"{self.name}-{p}", np.uint32)), np.asarray(self.store.read(f"{self.name}-runs-{p}", np.uint32)), {})
        return have

    def look(self, keys: np.ndarray, *names: str) -> list[np.ndarray]:
        """The values of each of the sorted keys, 0 where a key isn't there."""
        out = [np.zeros(len(keys), np.int64) for _ in names]
        part = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        edges = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)] if len(part) else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            p = int(part[a])
            have, starts, values = self._part(p)
            if not len(have):
                continue
            run, rest = self._cut(keys[a:b], (len(starts) - 1).bit_length() - 1)
            low, end = starts[run].astype(np.int64), starts[run + 1].astype(np.int64)
            high = end
            while len(live := np.flatnonzero(low < high)):  # all at once, each in its run
                mid = (low[live] + high[live]) >> 1
                less = have[mid] < rest[live]
                low[live[less]] = mid[less] + 1
                high = high.copy() if high is end else high
                high[live[~less]] = mid[~less]
            hit = np.flatnonzero((low < end) & (have[np.minimum(low, len(have) - 1)] == rest))
            for name, x in zip(names, out):
                if name not in values:
                    values[name] = self.store.small(f"{self.name}-{name}-{p}")
                x[a + hit] = values[name][low[hit]]
        return out


def store_arrays(rows: DataFrame, root: str, name: str, entries: int) -> Arrays:
    """Arrays of rows of longs: sorted by the first column, as an unsigned key, and dealt by its leading bits; the others are values."""
    key, *values = rows.columns
    store, bits = Store(root), part_bits(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[b.column(c).to_numpy() for c in (key, *values)] for b in batches if b.num_rows]
        if held:
            keys, *cols = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(keys.view(np.uint64), kind="stable")
            keys, part = keys.view(np.uint64)[order], keys.view(np.uint64)[order] >> np.uint64(64 - bits)
            for p in np.unique(part).tolist():
                store.put(f"{name}-{p}", keys[part == p])
                for v, c in zip(values, cols):
                    store.put(f"{name}-{v}-{p}", c[order][part == p])
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32())], ["part"])

    dealt = rows.repartition(1 << bits, F.shiftrightunsigned(key, 64 - bits))
    dealt.mapInArrow(trimmed(run), "part int").agg(F.count("*")).collect()
    return Arrays(store, name, np.uint64, bits, 64, dict.fromkeys(values, np.int64))


def part_bits(entries: int, each: int = PART_ENTRIES) -> int:
    """Leading bits of a key that name its part, for parts of about each entries."""
    return max(3, int(np.ceil(np.log2(max(1, entries) / each))))


def added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys with their sums."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(n, first)


def emit(part: np.ndarray, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(keys), 1 << 18):
        yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 18)]) for x in (part.astype(np.int32), keys.view(np.int64), n.astype(np.int64))], ["part", "key", "n"])


def gather(batches: Iterator[pa.RecordBatch], dtype) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, keys, sums) of the parts that a task holds."""
    held = [(b.column("part").to_numpy(), b.column("key").to_numpy().view(dtype), b.column("n").to_numpy()) for b in batches if b.num_rows]
    if held:
        part, keys, n = (np.concatenate(x) for x in zip(*held))
        del held
        for p in np.unique(part):
            mine = part == p
            yield int(p), *added(keys[mine], n[mine])
