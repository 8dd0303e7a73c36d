"""Byte-level BPE by an index of pair occurrences: texts to ids and ids to texts, as a tokenizer file says.

A text is cut into words by the file's pattern; what a partition's words are made of is looked up once. Words that a task
hasn't met yet are laid end to end as symbols, with links to the symbols before and after. An index maps the rank of each
pair to all its positions. Active ranks are taken in ascending order: all occurrences of the pair are merged at once, and the
pairs that they now form with their neighbours go to the lists of their own ranks, which are higher, as a symbol is made before
it is merged (files where that isn't so are refused). So a word gets the merges that it would get alone, one by one.

Words are gathered until they hold WORD_BYTES, so that an index is as large as that and no larger, whatever the texts; the
words that a task remembers are bounded by REMEMBERED. The vocabulary is read on the driver and broadcast: its size is that of
the file, whatever the table.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from docloom.llm.common import Shared, bounded_batches, table

#: Bytes of text whose new words share an index; words that a task remembers with their ids.
WORD_BYTES, REMEMBERED = 12 << 20, 400_000

# The words of byte-level BPE, and the letters and numbers that Unicode 16.0 has added to 15.1.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNICODE_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139),
    (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
]
#: Stands for a character that is no letter, number or space.
OTHER = "\uE000"


@functools.cache
def later() -> list[tuple[int, int]]:
    """Ranges that the regex library takes for letters or numbers and Unicode 16.0 doesn't know yet."""
    out, letter = [], regex.compile(r"[\p{L}\p{N}]")
    added = {c for a, b in UNICODE_16 for c in range(a, b + 1)}
    for c in range(0x110000):
        if unicodedata.category(chr(c)) == "Cn" and c not in added and letter.match(chr(c)):
            if out and out[-1][1] == c - 1:
                out[-1] = (out[-1][0], c)
            else:
                out.append((c, c))
    return out


class Words:
    """Cuts texts into words by the letters and numbers of Unicode 16.0, whatever version the regex library knows."""

    def __init__(self, ranges: list[tuple[int, int]]):
        self.cut = regex.compile(WORDS)
        self.later = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]") if ranges else None

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or self.later is None or not self.later.search(text):
            return self.cut.findall(text)
        return [text[slice(*m.span())] for m in self.cut.finditer(self.later.sub(OTHER, text))]


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizer file of byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as src:
            spec = json.load(src)
        model, cut, back = spec["model"], spec["pre_tokenizer"] or {}, spec["decoder"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")) and spec["normalizer"] is None
        plain &= cut.get("type") == back.get("type") == "ByteLevel" and not cut["add_prefix_space"] and cut["use_regex"]
        if not plain or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} isn't plain byte-level BPE")
        # bytes stand in the file as printable characters: themselves where Latin-1 prints them, else the next from U+0100 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        ids, vocab = [-1] * 256, model["vocab"]
        for c, b in byte_of.items():
            ids[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        raw = lambda t: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        parts = [b""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            parts[i] = raw(t)
        self.size, self.byte_ids = size, np.array(ids, np.int32)
        self.lengths, self.bytes = np.array([len(p) for p in parts], np.int64), np.frombuffer(b"".join(parts), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        made = {a + b: r for r, (a, b) in enumerate(pairs)}
        if any(made.get(x, -1) >= r for r, pair in enumerate(pairs) for x in pair) or len({*map(tuple, pairs)}) < len(pairs):
            raise ValueError(f"{path} has merges of symbols that later merges make")  # a merge could then make a pair of a lower rank
        ranks = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        keys = np.array([a * size + b for a, b in ranks], np.int64)
        self.keys, self.ranks = keys[o := np.argsort(keys)], np.array([*ranks.values()], np.int64)[o]
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.later = later()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 for those that never merge."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1) if len(self.keys) else np.full(len(key), -1)


class PairIndex:
    """Rank of a pair -> positions where it stands or stood; a heap of the ranks that have any."""

    def __init__(self):
        self.lists: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []

    def add(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        edges = np.flatnonzero(np.diff(ranks, prepend=-1, append=-1)).tolist()
        for a, b in zip(edges[:-1], edges[1:]):
            r = int(ranks[a])
            if r not in self.lists:
                self.lists[r] = []
                heapq.heappush(self.active, r)
            self.lists[r].append(positions[a:b])

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        while self.active:
            r = heapq.heappop(self.active)
            held = self.lists.pop(r)
            yield r, held[0] if len(held) == 1 else np.unique(np.concatenate(held))


def merge_words(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words end to end, number of ids of each word)."""
    lengths = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(lengths)
    symbol = vocab.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    n = len(symbol)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends[lengths > 0] - 1] = -1
    before[(ends - lengths)[lengths > 0]] = -1
    index = PairIndex()

    def enlist(at: np.ndarray) -> None:
        at = at[after[at] >= 0]
        ranks = vocab.rank(symbol[at], symbol[after[at]])
        index.add(ranks[some := ranks >= 0], at[some])

    enlist(np.arange(n))
    for r, at in index:
        a, b, merged = vocab.merges[r]
        at = at[(symbol[at] == a) & (after[at] >= 0)]
        right = after[at]
        keep = symbol[right] == b
        at, right = at[keep], right[keep]
        if a == b and len(at) > 1:  # in a run of one symbol every other pair merges, from its left end
            starts = np.flatnonzero(np.r_[True, at[1:] != right[:-1]])
            place = np.arange(len(at)) - np.repeat(starts, np.diff(starts, append=len(at)))
            at, right = at[place % 2 == 0], right[place % 2 == 0]
        beyond = after[right]
        symbol[at], symbol[right], after[at] = merged, -1, beyond
        before[beyond[beyond >= 0]] = at[beyond >= 0]
        left = before[at]
        enlist(np.unique(np.concatenate([left[left >= 0], at])))
    word = np.repeat(np.arange(len(words)), lengths)[alive := symbol >= 0]
    return symbol[alive], np.bincount(word, minlength=len(words))


class Numbers(dict):
    """Words and their numbers; a word that is asked for and not there is numbered and kept in new."""

    def __init__(self, words):
        super().__init__((w, k) for k, w in enumerate(words))
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = k = len(self)
        return k


class Encoder:
    """Encodes the texts of one task and remembers the words that it has merged."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.cut = vocab, Words(vocab.later)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(vocab.special, key=len, reverse=True))) + ")") if vocab.special else None
        self._forget()

    def _forget(self) -> None:
        # a special token is kept as if it were a word of one id, under a key that no word has
        self.numbers = Numbers((t,) for t in self.vocab.special)
        self.ids = np.array([*self.vocab.special.values()], np.int32)
        self.lengths, self.starts = np.ones(len(self.ids), np.int32), np.arange(len(self.ids))

    def _learn(self) -> None:
        ids, lengths = merge_words([w.encode() for w in self.numbers.new], self.vocab)
        self.numbers.new.clear()
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.ids, self.lengths = np.concatenate([self.ids, ids]), np.concatenate([self.lengths, lengths.astype(np.int32)])

    def words(self, text: str) -> list:
        if self.special is None or not self.special.search(text):
            return self.cut(text)
        return [w for k, part in enumerate(self.special.split(text)) for w in ([(part,)] if k % 2 else self.cut(part))]

    def encode(self, groups: Iterable[Iterable[str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each group of texts (ids of all its texts end to end, number of ids of each); new words of all groups are merged together."""
        if len(self.numbers) > REMEMBERED:
            self._forget()
        held = []
        for texts in groups:
            cut = [np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)) for words in map(self.words, texts)]
            held.append((np.concatenate([np.zeros(0, np.int32), *cut]), np.array([len(c) for c in cut], np.int64)))
        if self.numbers.new:
            self._learn()
        for at, words in held:
            n = self.lengths[at]
            ends = np.r_[0, np.cumsum(n, dtype=np.int64)]
            place = np.arange(ends[-1], dtype=np.int64)
            place += np.repeat(self.starts[at] - ends[:-1], n)
            yield self.ids[place], np.diff(ends[np.cumsum(words)], prepend=0)


def decode_ids(ids: np.ndarray, vocab: Vocabulary) -> bytes:
    """UTF-8 of the text of ids; ids that the vocabulary lacks have none, bytes that are no UTF-8 become U+FFFD."""
    ids = ids[(ids >= 0) & (ids < vocab.size)]
    n = vocab.lengths[ids]
    ends = np.cumsum(n)
    data = vocab.bytes[np.repeat(vocab.starts[ids] - (ends - n), n) + np.arange(ends[-1] if len(n) else 0)].tobytes()
    try:
        data.decode()
    except UnicodeDecodeError:
        return data.decode(errors="replace").encode()
    return data


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches together until their texts hold WORD_BYTES; a longer text is alone with its batch."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column("given").nbytes
        if size >= WORD_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _encode(shared: Shared, packed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for some in _gathered(batches):
            encoder = encoder or Encoder(shared.value())
            groups = ((x.as_py() or "" for x in b.column("given")) for b in some)
            for b, (ids, n) in zip(some, encoder.encode(groups)):
                offsets = np.r_[0, np.cumsum(n)]
                if packed:
                    made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(b), [None, pa.py_buffer(offsets * 4), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
                else:
                    made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column("record"), made], ["record", "made"])

    return run


def _decode(shared: Shared, packed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = None
        for b in batches:
            vocab = vocab or shared.value()
            rows = b.column("given")
            each = (None if not x.is_valid else np.frombuffer(x.as_buffer(), "<u4").astype(np.int64) if packed else pc.fill_null(x.values, -1).to_numpy(zero_copy_only=False).astype(np.int64) for x in rows)
            texts = pa.array([None if ids is None else decode_ids(ids, vocab) for ids in each], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column("record"), texts], ["record", "made"])

    return run


def _through(df: DataFrame, run, given: str, made: str, kind: str, keep: list[str] | None) -> DataFrame:
    """The columns keep of df (all) and made, which run makes of the column given; a column of that name is replaced."""
    bounded_batches(df.sparkSession)
    keep = [c for c in (df.columns if keep is None else keep) if c != made]
    sent = df.select(F.col(f"`{given}`").alias("given"), F.struct(F.lit(0).alias("c"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep))).alias("record"))
    back = sent.mapInArrow(run, StructType([sent.schema["record"], *StructType.fromDDL(f"made {kind}")]))
    return back.select(*(F.col(f"record.c{k}").alias(c) for k, c in enumerate(keep)), F.col("made").alias(made))


def encode(docs: DataFrame, path: str, keep: list[str] | None = None, packed: bool = False) -> DataFrame:
    """docs (or its columns keep) with ids array<int>, the tokens of each whole text under the tokenizer file at path.

    packed: ids are binary instead, 32-bit little-endian numbers. A null or empty text has no ids. Rows of repeated or null ids
    are encoded each; texts may have any length, and the ids of one text are held by one task. An empty table gives no rows.
    Other columns stay, whatever their names; one named ids is replaced. Special tokens of the file that stand in a text become
    their id. The driver reads the file, so executors don't need it.
    """
    shared = Shared(docs.sparkSession, Vocabulary(path))
    return _through(docs, _encode(shared, packed), "text", "ids", "binary" if packed else "array<int>", keep)


def decode(tokens: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """tokens (or its columns keep) with decoded, the text of each row's ids (array or packed), special tokens included.

    Null ids have a null text, no ids the empty one; ids that the file lacks, null ones among them, have no text. Bytes that
    don't form UTF-8 become U+FFFD. Repeated rows are decoded each; an empty table gives no rows. Other columns stay, whatever
    their names; one named decoded is replaced.
    """
    shared = Shared(tokens.sparkSession, Vocabulary(path))
    return _through(tokens, _decode(shared, isinstance(tokens.schema["ids"].dataType, BinaryType)), "ids", "decoded", "string", keep)


def op13(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Digests of every whole text's ids and of the text that they decode to, by the public 50k byte-level file unless path names another."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, keep=["doc_id"], packed=True)
    back = decode(ids, path)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
