"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of our own on one machine and an error on several."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="docloom-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df there as Parquet and reads it back: nothing is computed twice, and nothing stays in executors' memory or is lost with one."""
    spark = df.sparkSession
    path = f"{folder(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # files of shuffles that are over stay until Python's and then the driver's garbage is collected
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)
