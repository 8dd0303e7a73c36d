import zlib

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, score string, shard string, __row_key string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, empty and blank texts, ties, repeated rows, a very long text and columns with clashing names."""
    long = " ".join(f"word{k % 997} item{k}" for k in range(60_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf tonight", "en", "a", 10),
        (1, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf tonight", "en", "a", 10),
        (2, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf tonight", "en", None, 10),
        (3, None, None, None, None), (4, "", "en", "a", 0), (5, " \n\t ", "de", "b", 4), (6, "12345 !!! 678", None, "b", 13),
        (None, "An id is missing here", "en", "b", 21), (None, None, None, None, None), (7, long, "en", "a", len(long)),
        (8, "Über die Straße: Äpfel, Öl — ÇA VA? 中文字符", "de", "", 30), (1, "Another text under the same id", "en", "a", 31),
    ]
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def fold(doc_id, mod):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % mod


def whole(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")
