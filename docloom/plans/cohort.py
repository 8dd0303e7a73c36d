"""From a folder of submissions to scored reports, their summary and the rows that teams share, in one call."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import replies, scoring, shaping, similarity
from docloom.plans import rubric
from docloom.sources import files
from docloom.sources.scratch import materialise

_IMAGES = "array<struct<width:int,height:int,n_boxes:int,n_ellipses:int,n_lines:int,has_diagram_structure:boolean,type_guess:string,page:int,repeated_count:int>>"


class Cohort(NamedTuple):
    """documents: what was read of each team. files: what became of each file. reports: scores. summary: their cross-check rows.

    copied: pairs of requirement rows of different teams that match, with their ids. boilerplate: rows that min_docs teams have.
    """

    documents: DataFrame
    files: DataFrame
    reports: DataFrame
    summary: DataFrame
    copied: DataFrame
    boilerplate: DataFrame


def assess(spark: SparkSession, folder: str, doc_type: str, client: Callable[[str], str], replies_root: str, pdf: files.PdfDecoder | None = None, structural: bool = True, **asking) -> Cohort:
    """Reads a folder, asks client about every document and compares all requirement rows.

    Replies are kept in replies_root, so that a run after a killed one asks only for what isn't there; asking goes to replies.ask().
    A file that can't be read has an error in files and no report; one whose reply fails has a report with the error.
    """
    rubric.check_doc_type(doc_type)
    docs, listed = files.batch(spark, folder, pdf)
    docs = docs.withColumn("doc_id", F.col("team_id")).withColumn("doc_type", F.lit(doc_type)).withColumn("images", F.lit(None).cast(_IMAGES))
    answered = replies.ask(scoring.prompts(docs).select("doc_id", "prompt"), client, replies_root, **asking)
    reports = materialise(scoring.reports(docs, answered.select("doc_id", "raw", "error")), "reports")
    found = materialise(shaping.requirement_rows(docs).withColumn("row_idx", F.struct("table_idx", "row_idx")).drop("table_idx"), "rows")
    rows = found.select("doc_id", "row_idx", "text")
    pairs = materialise(similarity.list_pairs(rows, structural), "pairs")
    ids = lambda x: found.select(F.col("doc_id").alias(f"doc_{x}"), F.col("row_idx").alias(f"row_{x}"), F.col("req_id").alias(f"req_id_{x}"))
    copied = similarity.copied_rows(rows, structural, pairs=pairs).join(ids("a"), ["doc_a", "row_a"]).join(ids("b"), ["doc_b", "row_b"])
    return Cohort(docs.drop("images"), listed, reports, scoring.batch_summary(reports), copied, similarity.boilerplate(rows, pairs))
