"""Model replies that survive lost executors and killed runs: each is stored as it comes, and no stored call is made again.

Replies are files in a shared folder by bucket of the prompt's hash. A run takes distinct prompts, leaves out those that have a
stored reply, and deals the rest to tasks by bucket. A task asks for a bucket's prompts with a bounded number of calls at a
time and writes every few replies as one file, under its final name in one step. Before it begins a bucket it looks at what is
stored there, so that a task that is run again asks only for what its first attempt didn't store.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, as_completed
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.scoring import ATTEMPTS, PAUSE_S
from docloom.sources import store
from docloom.sources.scratch import materialise

#: Buckets of the folder, calls of a task at a time, replies of a file at most.
BUCKETS, CALLS, FILE_REPLIES = 256, 8, 32
_STORED = pa.schema([("key", pa.string()), ("raw", pa.string())])


def _folder(root: str, bucket: int) -> tuple[fs.FileSystem, str]:
    parsed = urlparse(root)
    system, path = (fs.LocalFileSystem(), parsed.path) if parsed.scheme in ("", "file") else fs.FileSystem.from_uri(root)
    return system, f"{path}/bucket={bucket}"


def _keys(root: str, bucket: int) -> set[str]:
    system, path = _folder(root, bucket)
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return set()
    files = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(".parquet") and not f.base_name.startswith(("_", "."))]
    return {k for f in files for k in pq.read_table(f, columns=["key"], filesystem=system, partitioning=None).column("key").to_pylist()}


def _store(root: str, bucket: int, rows: list[tuple[str, str]]) -> None:
    system, path = _folder(root, bucket)
    system.create_dir(path, recursive=True)
    name = uuid.uuid4().hex
    pq.write_table(pa.table(list(zip(*rows)), schema=_STORED), f"{path}/.{name}", filesystem=system)
    system.move(f"{path}/.{name}", f"{path}/{name}.parquet")


def _asked(client: Callable[[str], str], prompt: str, attempts: int, pause_s: float) -> tuple[str | None, str | None]:
    error = None
    for k in range(attempts):
        try:
            return client(prompt), None
        except Exception as x:
            error = str(x)
            if k + 1 < attempts:
                time.sleep(pause_s)
    return None, error


def _ask(root: str, client: Callable[[str], str], attempts: int, pause_s: float, calls: int, replies: int):
    """(key, error) of the prompts that got no reply; rows (bucket, key, prompt) come bucket by bucket."""

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[str, str]]]]:
        """Up to `replies` prompts of one bucket at a time."""
        now, held = None, []
        for b in batches:
            for bucket, key, prompt in zip(*(b.column(c).to_pylist() for c in ("bucket", "key", "prompt"))):
                if held and (bucket != now or len(held) == replies):
                    yield now, held
                    held = []
                now = bucket
                held.append((key, prompt))
        if held:
            yield now, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, have = None, set()
        with ThreadPoolExecutor(calls) as pool:
            for bucket, rows in bucketed(batches):
                if bucket != at:
                    at, have = bucket, _keys(root, bucket)
                asked = {pool.submit(_asked, client, prompt, attempts, pause_s): key for key, prompt in rows if key not in have}
                got, failed = [], []
                try:
                    for done in as_completed(asked):
                        raw, error = done.result()
                        got.append((asked[done], raw)) if error is None else failed.append((asked[done], error))
                finally:  # what came is stored even if the rest doesn't come
                    if got:
                        _store(root, bucket, got)
                if failed:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*failed)], ["key", "error"])

    return run


def stored(spark: SparkSession, root: str) -> DataFrame:
    """(key, raw) of all stored replies; of a key that two attempts stored one counts."""
    if not store.exists(spark, root):
        return spark.createDataFrame([], "key string, raw string")
    return spark.read.schema("key string, raw string, bucket int").parquet(root).groupBy("key").agg(F.min("raw").alias("raw"))


def ask(prompted: DataFrame, client: Callable[[str], str], root: str, attempts: int = ATTEMPTS, pause_s: float = PAUSE_S, calls: int = CALLS, replies: int = FILE_REPLIES) -> DataFrame:
    """prompted (doc_id, prompt) with raw and error: replies of client, stored in the folder root, or what its last attempt failed with.

    client is sent to the executors and called by `calls` threads of a task. A prompt that several documents have is asked once, and
    one that a run has stored is never asked again; one that failed is asked again by the next run. A null prompt gets neither
    reply nor error. What a killed task had asked and not yet stored, `replies` calls at most, is asked again.
    """
    spark = prompted.sparkSession
    keyed = prompted.withColumn("key", F.sha2("prompt", 256))
    distinct = keyed.where("key IS NOT NULL").groupBy("key").agg(F.min("prompt").alias("prompt"))
    todo = distinct.join(stored(spark, root), "key", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))
    tasks = min(BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    dealt = todo.select("bucket", "key", "prompt").repartition(tasks, "bucket").sortWithinPartitions("bucket", "key")
    errors = materialise(dealt.mapInArrow(_ask(root, client, attempts, pause_s, calls, replies), "key string, error string"), "errors")
    return keyed.join(stored(spark, root), "key", "left").join(errors, "key", "left").withColumn("error", F.when(F.col("raw").isNull(), F.col("error"))).drop("key")
