"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters records by seeded hashes: a record's shard is the winner of a rendezvous over the shards (doc_id and
the number of shards decide, and one more shard takes rows only into itself), and inside a shard a second hash picks one
of several memory-sized buckets. Pass two gathers each bucket, puts it in a canonical order, shuffles it by Fisher-Yates
(Spark's shuffle() with a seed) and numbers its rows after those of the shard's earlier buckets.

Only keys hash here, never texts or sources, so a hot source or a group of copies spreads over all buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import table

SHARDS, SEED = 40, 20240607
#: Bytes of records that a bucket holds on average.
BUCKET_BYTES = 4 << 20
ROW_BYTES = 16


def shard_of(doc_id: Column, shards: int, seed: int = SEED) -> Column:
    """Rendezvous hashing: the shard whose hash with doc_id is highest. A null id goes to a fixed shard."""
    draws = [F.struct(F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(k), F.lit(seed)).alias("h"), F.lit(k).alias("k")) for k in range(shards)]
    return F.greatest(*draws)["k"]


def record_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, size: Column | None = None) -> DataFrame:
    """docs with shard, slot (gapless from 0 in each shard, in shuffled order) and grown_shard (with one shard more).

    size gives a record's bytes in memory (default: its text and a fixed part). Null texts count as empty; very long texts are
    records like any other. Repeated rows and repeated ids are records of their own; all rows of one id share a shard. Columns
    of any type are carried; those with the three new names are replaced. An empty table gives no rows. The order depends on
    the rows and the seed alone (rows that repeat both id and text may swap places).
    """
    cols = [c for c in docs.columns if c not in ("shard", "slot", "grown_shard")]
    total = docs.agg(F.sum(record_bytes(F.col("text")) if size is None else size)).first()[0] or 0
    per_shard = max(8, math.ceil(total / shards / bucket_bytes))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    same = F.col("text") if "text" in cols else key
    # rows that share an id are told apart by their text, so one id can't fill a bucket with different rows
    bucket = F.pmod(F.xxhash64(key, same, F.lit(seed + 1)), F.lit(per_shard)).cast("int")
    scattered = docs.select(
        F.struct(*cols).alias("record"), shard_of(F.col("doc_id"), shards, seed).alias("shard"), bucket.alias("bucket"), F.xxhash64(key, F.lit(seed + 2)).alias("order"), F.xxhash64(same, F.isnull(same), F.lit(seed + 3)).alias("tie")
    )
    counts = scattered.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    # rows in the shard's earlier buckets; a shard has as many rows here as buckets
    earlier = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # as many tasks as buckets, whatever the session's setting: shuffle() draws by seed and task, so the same rows fall alike
    dealt = scattered.repartition(shards * per_shard, "shard", "bucket")
    gathered = dealt.groupBy("shard", "bucket").agg(F.collect_list(F.struct("order", "tie", "record")).alias("rows"))
    # the records themselves aren't compared: they may hold maps
    less = lambda a, b: F.when((a["order"] < b["order"]) | ((a["order"] == b["order"]) & (a["tie"] < b["tie"])), -1).when((a["order"] == b["order"]) & (a["tie"] == b["tie"]), 0).otherwise(1)
    shuffled = gathered.sortWithinPartitions("shard", "bucket").select("shard", "bucket", F.shuffle(F.array_sort("rows", less), seed).alias("rows"))
    placed = shuffled.join(offsets.hint("shuffle_hash"), ["shard", "bucket"])
    drawn = placed.select("shard", "before", F.posexplode("rows").alias("at", "row"))
    return drawn.select(
        *(F.col("row.record")[c].alias(c) for c in cols), "shard", (F.col("before") + F.col("at")).alias("slot"), shard_of(F.col("row.record.doc_id"), shards + 1, seed).alias("grown_shard")
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in SHARDS shards, under the law "key"; whole records are moved, and the digests are of the texts that arrive."""
    placed = shuffle_into_shards(table(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return placed.select("doc_id", record_bytes(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")
