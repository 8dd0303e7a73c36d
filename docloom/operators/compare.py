"""Hand marks against system scores, cohort figures, and the lists that a reviewer filters and sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import marks
from docloom.functions import text as X
from docloom.operators.matching import latest_file

LOW_SCORE, LOW_GROUNDING = 50, 0.8
#: Column of the team table that holds the hand mark of each doc_type.
MARK_COLUMNS = {"srs": "srs_mark", "test_plan": "test_plan_mark", "sads": "sad_mark"}


def hand_maximum(sheets: DataFrame) -> DataFrame:
    """(doc_type, hand_max) of sheets (sheet_ord, doc_type, value): the last sheet that has one."""
    return sheets.where("value IS NOT NULL").groupBy("doc_type").agg(F.max_by("value", "sheet_ord").alias("hand_max"))


# Headings of a roster sheet that hold the maximum mark of each doc_type.
MAXIMUM_HEADINGS = {"SRS": "srs", "Test Plan": "test_plan", "SAD": "sads"}


def sheet_maxima(sheets: DataFrame) -> DataFrame:
    """(sheet_ord, doc_type, value) of the row of maximum marks (row 1) of roster sheets (sheet_ord, row_idx, cells by heading)."""
    pairs = F.array(*(F.struct(F.lit(d).alias("doc_type"), F.try_element_at("cells", F.lit(h)).try_cast("double").alias("value")) for h, d in MAXIMUM_HEADINGS.items()))
    return sheets.where("row_idx = 1").select("sheet_ord", F.explode(pairs).alias("p")).select("sheet_ord", "p.doc_type", "p.value")


def hand_marks(teams: DataFrame) -> DataFrame:
    """(team_pk, name, doc_type, hand_score): one row per team and doc_type."""
    pairs = ", ".join(f"'{d}', {c}" for d, c in MARK_COLUMNS.items())
    name = F.coalesce(F.nullif("team_name", F.lit("")), F.concat(F.lit("team #"), F.coalesce(F.col("excel_team_id").cast("int").cast("string"), F.lit("?"))))
    return teams.select(F.col("id").alias("team_pk"), name.alias("name"), F.expr(f"stack({len(MARK_COLUMNS)}, {pairs}) AS (doc_type, hand_score)"))


def score_index(scores: DataFrame) -> DataFrame:
    """The report of each source by doc_type: of several the one with the last path; blank sources are left out."""
    order = W.partitionBy("doc_type", "source").orderBy(F.col("path").desc())
    return scores.where(F.coalesce("source", F.lit("")) != "").withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def compare(submissions: DataFrame, teams: DataFrame, scores: DataFrame, hand_max: DataFrame) -> DataFrame:
    """A row per team and doc_type with matched files: the newest file, both marks, their difference, and status (no_hand_mark, no_score, ok)."""
    chosen = latest_file(submissions.where("team_pk IS NOT NULL").withColumn("team", F.struct("team_pk", "doc_type")))
    joined = chosen.join(hand_marks(teams), ["team_pk", "doc_type"]).join(F.broadcast(hand_max), "doc_type", "left")
    found = joined.join(score_index(scores).select("doc_type", F.col("source").alias("filename"), "total_score", "max_total"), ["doc_type", "filename"], "left")
    status = F.when(F.col("hand_score").isNull(), "no_hand_mark").when(F.col("total_score").isNull(), "no_score").otherwise("ok")
    more = marks.scaled(F.col("total_score"), F.col("max_total"), F.col("hand_score"), F.col("hand_max"))
    return found.select(
        "doc_type", "team_pk", "name", "filename", "picked_from", status.alias("status"), "hand_score", "hand_max", F.col("total_score").alias("sys_score"), F.col("max_total").alias("sys_max"),
        *(F.when(status == "ok", c).alias(k) for k, c in more.items()),
    )


def worst_first(rows: DataFrame) -> DataFrame:
    """Rows without a difference first, then the largest."""
    return rows.orderBy(F.col("diff_pct").isNull().desc(), F.abs("diff_pct").desc(), "name")


def agreement(rows: DataFrame) -> DataFrame:
    """Per doc_type: pairs, mean, mean absolute and population deviation of the difference, each also in percent of the hand maximum, and what is missing."""
    d, top = F.col("diff_scaled"), F.max("hand_max")
    figures = {"mean_diff": F.avg(d), "mean_abs_diff": F.avg(F.abs(d)), "stddev_diff": F.stddev_pop(d)}
    return rows.groupBy("doc_type").agg(
        F.count(d).alias("n"), *(c.alias(k) for k, c in figures.items()), *(F.try_divide(c * 100.0, top).alias(f"{k}_pct") for k, c in figures.items()),
        F.count_if(F.col("status") == "no_hand_mark").alias("n_no_hand_mark"), F.count_if(F.col("status") == "no_score").alias("n_no_score"),
    )


def missing(rows: DataFrame, status: str) -> DataFrame:
    """Per doc_type: the sorted names of the teams of that status, and how many."""
    return rows.where(F.col("status") == status).groupBy("doc_type").agg(F.sort_array(F.collect_list("name")).alias("names"), F.count("*").alias("n"))


def with_scores(ingested: DataFrame, scores: DataFrame) -> DataFrame:
    """ingested left-joined to its score by (doc_type, team_id); score_is_stale marks a score of another file than the present one."""
    s = scores.select("doc_type", "team_id", F.col("source").alias("score_source"), "percentage", "total_score", "flags", "extracted_ids", "sanity_check")
    out = ingested.join(s, ["doc_type", "team_id"], "left")
    return out.withColumn("score_is_stale", F.coalesce(F.col("score_source") != F.col("source"), F.lit(False)))


def team_ids(rows: DataFrame) -> DataFrame:
    """Distinct team_id, sorted."""
    return rows.select("team_id").distinct().orderBy("team_id")


def team_listing(ingested: DataFrame, scores: DataFrame, doc_type: str) -> DataFrame:
    """(team_id, source, raw_text, tables, score) of the ingested documents of a doc_type, sorted; score is the team's report as a struct, null without one.

    A document without a source goes by its team_id; without text or tables these are empty.
    """
    s = scores.where(F.col("doc_type") == doc_type).select("team_id", F.struct(*(c for c in scores.columns if c != "team_id")).alias("score"))
    d = ingested.where(F.col("doc_type") == doc_type).join(s, "team_id", "left")
    empty = F.array().cast(ingested.schema["tables"].dataType)
    return d.select("team_id", F.coalesce("source", "team_id").alias("source"), F.coalesce("raw_text", F.lit("")).alias("raw_text"), F.coalesce("tables", empty).alias("tables"), "score").orderBy("team_id")


def cohort(rows: DataFrame, percentage: str = "percentage", flag: str = "flags", cited: str = "cited_count", fraction: str = "grounded_fraction") -> DataFrame:
    """One row: documents, scored, mean percentage to one place, flagged, with low grounding (only if something is cited)."""
    p = F.col(percentage)
    return rows.agg(
        F.count("*").alias("n"), F.count(p).alias("n_scored"), F.round(F.avg(p), 1).alias("avg_percentage"), F.count(marks.flag_tone(F.col(flag))).alias("n_flagged"),
        F.count_if((F.col(cited) > 0) & (F.col(fraction) < LOW_GROUNDING)).alias("n_low_grounding"),
    )


def search(rows: DataFrame, query: str = "", only: str = "all") -> DataFrame:
    """Rows whose team_id has the query (case and outer spaces aside), and that are all, unscored, flagged or lowscore."""
    q = query.strip().lower()
    keep = {"all": F.lit(True), "unscored": F.col("percentage").isNull(), "flagged": marks.flag_tone(F.col("flags")).isNotNull(), "lowscore": F.col("percentage") < LOW_SCORE}
    if only not in keep:
        raise ValueError(f"only must be one of {list(keep)}")
    return rows.where((F.contains(F.lower("team_id"), F.lit(q)) if q else F.lit(True)) & keep[only])


def id_count(ids: Column, category: str) -> Column:
    """Number of cited items of a category; null without any record of it."""
    items = F.try_element_at(ids, F.lit(category))
    return F.when(items.isNotNull(), F.size(items))


def sort_rows(rows: DataFrame, key: str = "team_id", descending: bool = False) -> DataFrame:
    """Sorted by team_id, score, grounded or idcount:<category>; missing values count as -1, ties stay by team_id."""
    cols = {"team_id": F.lower("team_id"), "score": F.coalesce("percentage", F.lit(-1.0)), "grounded": F.coalesce("sanity_check.grounded_fraction", F.lit(-1.0)) if "sanity_check" in rows.columns else F.lit(-1.0)}
    col = F.coalesce(id_count(F.col("extracted_ids"), key.split(":", 1)[1]), F.lit(-1)) if key.startswith("idcount:") else cols[key]
    return rows.orderBy(col.desc() if descending else col.asc(), F.lower("team_id"))


def id_chips(rows: DataFrame) -> DataFrame:
    """(doc_id, category, item, ungrounded) of every cited item of reports."""
    each = rows.select("doc_id", F.explode("extracted_ids").alias("category", "items"), F.col("sanity_check.ungrounded_ids").alias("bad"))
    return each.select("doc_id", "category", F.explode("items").alias("item"), "bad").select("doc_id", "category", "item", F.array_contains("bad", F.col("item")).alias("ungrounded"))


def label(team_name: Column, number: Column) -> Column:
    return F.coalesce(F.nullif(X.strip(team_name), F.lit("")), F.concat(F.lit("team #"), number.cast("int").cast("string")))
