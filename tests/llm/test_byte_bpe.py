import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docloom.llm import byte_bpe as B

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "  \n\n \t x", "a", "aaaa" * 9, "Hello world's 1234 don't!!", "<|endoftext|>", "x<|endoftext|> <|endoftext|>y<|endoftext", "Straße 中文字符 🎉🎉  é   z", "\x00\x1c\x1d \x85", "ab" * 5000,
    "Ᲊᲊ aꟋ1՘՘ ౜", " " * 3000, "I'll we've 'S '", "\r\n\r\n\r\n", "٣٤٥ Ⅷ ²", "𝔘𝔫𝔦  ￿",
]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def digests(whole, text):
    ids = whole.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_query_equals_the_library(spark, sf, whole):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(tuple(r) for r in B.op13(spark, sf).collect()) == sorted((d, *digests(whole, t)) for d, t in rows)


def test_texts_equal_the_library(whole):
    draw = random.Random(3)
    some = ["a", "b", " ", "\n", "'s", "é", "1", "!", "<|endoftext|>", "the", " ", "🎉", "Z", "ing"]
    texts = TEXTS + ["".join(draw.choices(some, k=draw.randrange(40))) for _ in range(2000)]
    encoder = B.Encoder(B.Vocabulary(PATH))
    for _ in range(2):  # the second time from memory
        split = [x.tolist() for ids, n in encoder.encode([texts[:9], [], texts[9:]]) for x in np.split(ids, np.cumsum(n)[:-1]) if len(n)]
        assert split == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_letters_of_all_of_unicode(whole):
    words = B.Words(B.later())
    for first in range(0, 0x110000, 64):
        s = " ".join(f"a{c}{c}1{c}!{c} {c}" for c in map(chr, range(first, first + 64)) if not 0xD800 <= ord(c) < 0xE000)
        assert words(s) == [s[a:b] for _, (a, b) in whole.pre_tokenizer.pre_tokenize_str(s)]


def test_any_ids_decode_as_in_the_library(spark, whole):
    draw = np.random.default_rng(1)
    rows = [(k, draw.integers(0, 50257, int(n)).tolist(), "x") for k, n in enumerate(draw.integers(0, 30, 200))] + [(900, None, "y"), (901, [70_000, -3, None, 50256], None)]
    got = {r.k: r.decoded for r in B.decode(spark.createDataFrame(rows, "k long, ids array<int>, decoded string"), PATH).collect()}
    assert got[900] is None and got[901] == "<|endoftext|>"
    assert all(got[k] == whole.decode(ids, skip_special_tokens=False) for k, ids, _ in rows[:200])


def naive(word, merges):
    s = [bytes([b]) for b in word]
    while pairs := [(merges[p], k) for k, p in enumerate(zip(s, s[1:])) if p in merges]:
        _, k = min(pairs)
        s[k : k + 2] = [s[k] + s[k + 1]]
    return s


def small(tmp_path, merges):
    vocab = {chr(c) if 0x20 < c < 0x7F or 0xA0 < c < 0x100 and c != 0xAD else None: c for c in range(256)}
    vocab.pop(None)
    hidden = [b for b in range(256) if chr(b) not in vocab]
    vocab |= {chr(256 + k): b for k, b in enumerate(hidden)}
    vocab |= {a + b: 300 + k for k, (a, b) in enumerate(merges)}
    spec = json.load(open(PATH))
    spec["model"] |= {"vocab": vocab, "merges": [" ".join(m) for m in merges]}
    (tmp_path / "t.json").write_text(json.dumps(spec))
    return B.Vocabulary(str(tmp_path / "t.json")), {i: t.encode() for t, i in vocab.items() if i >= 300 or i in b"ab"}


def test_merges_one_by_one(tmp_path):
    merges = [("a", "b"), ("a", "a"), ("aa", "b"), ("b", "b"), ("a", "aab"), ("ab", "b"), ("aab", "a"), ("aa", "aa"), ("b", "a"), ("a", "ba")]
    v, name = small(tmp_path, merges)
    draw = random.Random(5)
    words = sorted({"".join(draw.choices("ab", k=draw.randrange(1, 14))).encode() for _ in range(600)})
    ids, n = B.merge_words(words, v)
    ranks = {(a.encode(), b.encode()): k for k, (a, b) in enumerate(merges)}
    assert [[name[i] for i in x] for x in np.split(ids, np.cumsum(n)[:-1])] == [naive(w, ranks) for w in words]


def test_odd_rows_small_indexes_and_no_rows(spark, odd_docs, no_docs, whole, monkeypatch):
    monkeypatch.setattr(B, "WORD_BYTES", 10)
    monkeypatch.setattr(B, "REMEMBERED", 5)
    docs = odd_docs.withColumnRenamed("shard", "ids").withColumnRenamed("score", "decoded")
    back = B.decode(B.encode(docs, PATH), PATH)
    assert set(back.columns) == set(docs.columns)
    got = sorted(((r.doc_id, r.text, r.ids, r.decoded, r.spans) for r in back.collect()), key=repr)
    assert got == sorted(((r.doc_id, r.text, whole.encode(r.text or "", add_special_tokens=False).ids, r.text or "", "x") for r in docs.collect()), key=repr)
    assert B.encode(no_docs, PATH).count() == 0 and B.decode(B.encode(no_docs, PATH, packed=True), PATH).count() == 0


def test_other_files_are_refused(tmp_path):
    with pytest.raises(ValueError):
        small(tmp_path, [("aa", "b"), ("a", "a")])
    with pytest.raises(ValueError):
        B.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
