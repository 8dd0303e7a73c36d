"""SimHash near-dedup by multi-index hashing.

Fingerprints are linked when they differ in at most RADIUS bits. Each 64-bit fingerprint is cut into SEGMENTS
segments; two fingerprints within RADIUS bits agree up to RADIUS // SEGMENTS bits in at least one of them. Every
fingerprint is stored once per segment and looked up with the small Hamming ball of each of its segments; a match is
verified over all 64 bits inside the join. Components come from large-star/small-star rounds over the links.

Only distinct fingerprints enter the search, so thousands of exact copies cost one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import bounded_batches, materialise, row_key, table

RADIUS, SEGMENTS, SHINGLE = 3, 2, 3


def majority(h: np.ndarray) -> int:
    """Signed 64 bits, each 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 14):  # bounded for very long texts
        part = h[k : k + (1 << 14)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text's UTF-8 bytes. No words (null, empty or blank text): 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    return majority(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64)) & ((1 << 64) - 1)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), pa.array(fps.view(np.int64))], ["doc_id", "row_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, fp) for every row of docs, whole texts."""
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long"), row_key().alias("row_key"), F.col("text").cast("binary").alias("text"))
    return src.mapInArrow(_fingerprints, "doc_id long, row_key long, fp long")


def _segments(fp: str) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    width = 64 // SEGMENTS
    return [(k * width, 64 - k * width if k == SEGMENTS - 1 else width) for k in range(SEGMENTS)]


def links(fps: DataFrame) -> DataFrame:
    """All pairs a < b of distinct fingerprints (column fp) that differ in at most RADIUS bits, as (a, b).

    Neither side is broadcast: Spark takes what explode() makes of a row, 66 rows for a probe, for one.
    """
    if RADIUS // SEGMENTS > 1:
        raise ValueError("balls of radius 0 and 1 only")

    def keys(ball: bool):
        parts = []
        for k, (low, width) in enumerate(_segments("fp")):
            mask = (1 << width) - 1
            value = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit(mask))
            tagged = value.bitwiseOR(F.lit(k << width)) if width < 62 else value
            parts.append(F.array(tagged))
            if ball and RADIUS // SEGMENTS:
                parts.append(F.array(*[tagged.bitwiseXOR(F.lit(1 << b)) for b in range(width)]))
        return F.explode(F.concat(*parts))

    stored = fps.select(F.col("fp").alias("a"), keys(ball=False).alias("key"))
    probes = fps.select(F.col("fp").alias("b"), keys(ball=True).alias("key"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    return stored.join(probes.hint("merge"), (stored.key == probes.key) & (F.col("a") < F.col("b")) & close).select("a", "b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of the undirected edges (a, b) reaches.

    Large-star and small-star in turn until nothing changes; each round is written to the shared folder. Raises if max_rounds don't settle it.
    """

    def mark(e: DataFrame):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return r.n, r.s

    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    last = mark(edges)
    for _ in range(max_rounds):
        if not last[0]:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("u")).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(low2, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(low2.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        edges = materialise(small, "edges")
        now = mark(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components aren't settled after {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classes(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id) for each distinct fingerprint of prints (doc_id, fp); root tells components apart even where ids repeat."""
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    reach = components(links(nodes.select("fp")))
    # components() orders by fingerprint; the component's id is its smallest doc_id
    root = nodes.join(reach, nodes.fp == reach.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    ids = root.groupBy("root").agg(F.min("least").alias("component_id"))
    return root.select("fp", "root").join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, fp, root, component_id) for every row of docs.

    Null, empty and blank texts have fingerprint 0 and are linked like any other. Repeated rows and repeated ids stay
    separate rows. A null doc_id never names a component unless all its documents have none. An empty table gives no rows.
    """
    prints = materialise(fingerprints(docs), "prints")
    return prints.join(classes(prints), "fp")


def keep_one(docs: DataFrame, grouped: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """docs without near copies: of each component (root of grouped(docs)) the row with the smallest doc_id (ties: smallest row key) stays, with all columns."""
    found = grouped(docs)
    best = found.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "row_key")).alias("best"))
    kept = best.select(F.col("best.row_key").alias("row_key"))
    marked = docs.select(row_key().alias("row_key"), F.struct(*docs.columns).alias("record"))
    return marked.join(kept.hint("shuffle_hash"), "row_key", "left_semi").dropDuplicates(["row_key"]).select("record.*")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of the whole documents table."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
