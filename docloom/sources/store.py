"""Sinks and state: tables partitioned by doc_type, kept by resubmission rank, with snapshots before they are overwritten."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCORE_COLUMNS = ["team_id", "doc_type"]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def put(df: DataFrame, path: str, partition: str | None = "doc_type") -> None:
    """Overwrites the partitions that df has, or the whole table without one."""
    w = df.write.mode("overwrite")
    (w.option("partitionOverwriteMode", "dynamic").partitionBy(partition) if partition else w).parquet(path)


def put_counted(df: DataFrame, path: str, partition: str | None = "doc_type", **metrics: Column) -> dict:
    """put() that counts as it writes: the value of each metric, an aggregate without distinct, over the rows of the one pass that writes them."""
    seen = Observation()
    put(df.observe(seen, *(c.alias(k) for k, c in metrics.items())), path, partition)
    return seen.get


def put_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def newest(current: DataFrame, uploads: DataFrame) -> DataFrame:
    """Of each (doc_type, team_id) the row with the highest rank; the stored row stays on equal ranks, the first of equal uploads wins.

    current and uploads have the same columns, rank and upload_ord among them.
    """
    both = current.withColumn("__new", F.lit(0)).unionByName(uploads.withColumn("__new", F.lit(1)))
    order = W.partitionBy("doc_type", "team_id").orderBy(F.col("rank").desc(), "__new", "upload_ord")
    return both.withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__new", "__place")


def decisions(current: DataFrame, uploads: DataFrame) -> DataFrame:
    """uploads with skipped and reason, judged against what is stored."""
    kept = current.select("doc_type", "team_id", F.col("rank").alias("stored_rank"))
    out = uploads.join(kept, ["doc_type", "team_id"], "left")
    skip = F.col("stored_rank").isNotNull() & (F.col("rank") <= F.col("stored_rank"))
    return out.withColumn("skipped", skip).withColumn("reason", F.when(skip, F.lit("a submission of the same or a higher number is stored")))


def archive(spark: SparkSession, table: str, runs: str, prefix: str = "") -> int | None:
    """Appends a copy of the rows whose team_id begins with prefix to runs, as the next run_seq; None if there are none."""
    if not exists(spark, table):
        return None
    rows = spark.read.parquet(table).where(F.col("team_id").startswith(prefix))
    if rows.isEmpty():
        return None
    last = spark.read.parquet(runs).agg(F.max("run_seq")).first()[0] if exists(spark, runs) else None
    seq = (last or 0) + 1
    rows.withColumn("run_seq", F.lit(seq)).withColumn("run_ts", F.current_timestamp()).write.mode("append").parquet(runs)
    return seq


def build_roster(teams: DataFrame, members: DataFrame, submissions: DataFrame, root: str) -> None:
    """Writes the three relations anew."""
    for name, df in (("teams", teams), ("team_members", members), ("submissions", submissions)):
        put(df, f"{root}/{name}", None)


def submissions_report(submissions: DataFrame, teams: DataFrame) -> DataFrame:
    """Submissions with their teams, unmatched ones last, by section and team name (missing ones first)."""
    t = teams.select(F.col("id").alias("team_pk"), "section", "team_name")
    return submissions.join(t, "team_pk", "left").orderBy(F.isnull("team_pk"), F.asc_nulls_first("section"), F.asc_nulls_first("team_name"), "filename")


def render_html(rows: DataFrame, title: str, limit: int = 5000) -> str:
    """A page with one table of up to limit rows; for results of cohort size."""
    got = rows.limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"more than {limit} rows")
    cell = lambda v: html.escape(v if isinstance(v, str) else json.dumps(v, default=str, ensure_ascii=False)) if v is not None else ""
    head = "".join(f"<th>{html.escape(c)}</th>" for c in rows.columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in got)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><table><tr>{head}</tr>{body}</table></body></html>"
