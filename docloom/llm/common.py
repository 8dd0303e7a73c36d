"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import ctypes
import pickle
import tempfile
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that one Arrow batch to a Python worker may hold; long texts make small batches.
ARROW_BATCH_BYTES = 4 << 20
# Workers live on after a stage: memory that it needed goes back to the system, not to a pool of Arrow's.
pa.set_memory_pool(pa.system_memory_pool())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by whatever store Spark can read."""
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the bytes of each batch that goes to Python, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def trimmed(run):
    """run, for mapInArrow, after which the memory that it has freed goes back to the system: workers live on, and keep it else."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
            if trim is not None:
                trim(0)

    return wrapped


def scratch(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); where that is unset, a folder of our own on one machine and an error on several."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="docloom-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends here and every executor can reread it."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes what materialise() wrote, when nothing is left to read it."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fold(doc_id: Column | str, mod: int) -> Column:
    """crc32 of doc_id as text, modulo mod; a null doc_id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Tells rows apart even where doc_id repeats; equal only for repeated rows (same id, same text)."""
    return F.xxhash64(F.col(doc_id), F.isnull(doc_id), F.col(text), F.isnull(text), F.lit(0x5EED))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Shared:
    """A broadcast of any value of this package; value() loads it where it is asked for. The caller bounds its size."""

    def __init__(self, spark: SparkSession, value):
        self.data = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def value(self):
        return pickle.loads(self.data.value)
