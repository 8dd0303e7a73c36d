"""Queries over the driver's tables and the SQL that checks them.

The tables hold no requirement documents, rosters or marks; where an operator needs one, its input is made from columns of
the tables inside the query, over all their rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import marks
from docloom.functions import text as X
from docloom.operators import compare, matching, pages, replies, scoring, shaping, similarity
from docloom.plans import rubric
from docloom.sources import files, images, scratch, sqlite, store
from docloom.sources.scratch import materialise
from docloom.streaming import uploads

#: The whitespace class in DuckDB's dialect.
_WS = r"'[\s\p{Z}' || chr(28) || '-' || chr(31) || chr(133) || ']'"
_STRIP = "regexp_replace({0}, '^' || ws || '+|' || ws || '+$', '', 'g')"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(d).rstrip('/')}/{name}.parquet")


def _rows(spark, d):
    return materialise(similarity.listed(similarity.document_rows(_t(spark, d, "documents"))), "rows")


def line_rows(spark, d):
    return similarity.document_rows(_t(spark, d, "documents")).select("doc_id", F.col("row_idx").cast("long").alias("row_idx"), "text")


_LINES = f"""
w AS (SELECT {_WS} AS ws),
rows_ AS MATERIALIZED (
  SELECT doc_id, row_idx, text FROM (
    SELECT doc_id, nr - 1 AS row_idx, {_STRIP.format("regexp_replace(line, '(?i)\\b[a-z]{2,6}-(?:F|NF|SEC)-[0-9]{2,4}\\b', '', 'g')")} AS text, ws
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nr FROM documents), w)
  WHERE len(list_filter(regexp_split_to_array(text, ws || '+'), lambda x: x <> '')) >= 5)"""
_TOKENS = f"""{_LINES},
toks AS MATERIALIZED (SELECT doc_id, row_idx, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM rows_),
lists AS MATERIALIZED (SELECT DISTINCT array_to_string(t, ' ') AS k, t FROM toks WHERE len(t) > 0),
sh AS MATERIALIZED (SELECT k, list_distinct(CASE WHEN len(t) < 5 THEN [k] ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(list_slice(t, i, i + 4), ' ')) END) AS s FROM lists),
ex AS MATERIALIZED (SELECT k, len(s) AS n, unnest(s) AS g FROM sh),
jp AS MATERIALIZED (
  SELECT a.k AS x, b.k AS y, count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) AS jaccard
  FROM ex a JOIN ex b ON a.g = b.g GROUP BY a.k, b.k HAVING count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.55)"""
_COMMON = f"""{_TOKENS},
held AS (SELECT DISTINCT array_to_string(t, ' ') AS k, doc_id FROM toks WHERE len(t) > 0),
near AS MATERIALIZED (SELECT DISTINCT jp.x AS k, h.doc_id FROM jp JOIN held h ON h.k = jp.y),
own AS (SELECT k, count(*) AS owners FROM near GROUP BY k),
common AS MATERIALIZED (SELECT t.doc_id, t.row_idx, o.owners FROM toks t JOIN own o ON o.k = array_to_string(t.t, ' ') WHERE len(t.t) > 0 AND o.owners >= 3)"""
_COPIED = f"""{_COMMON},
keep AS MATERIALIZED (SELECT t.*, array_to_string(t.t, ' ') AS k FROM toks t ANTI JOIN common c ON t.doc_id = c.doc_id AND t.row_idx = c.row_idx WHERE len(t.t) > 0),
copied AS (
  SELECT a.doc_id AS doc_a, a.row_idx AS row_a, b.doc_id AS doc_b, b.row_idx AS row_b, round(jp.jaccard, 3) AS jaccard
  FROM keep a JOIN jp ON jp.x = a.k JOIN keep b ON b.k = jp.y WHERE a.doc_id < b.doc_id)"""


#: ratio_ (pid, ratio) of prs (pid, ta, tb): the longest common block of each window, then the windows left and right of it.
_RATIO = """
hit_ AS (SELECT a.pid, a.i, b.i AS j FROM (SELECT pid, unnest(ta) AS x, generate_subscripts(ta, 1) AS i FROM prs) a JOIN (SELECT pid, unnest(tb) AS x, generate_subscripts(tb, 1) AS i FROM prs) b ON a.pid = b.pid AND a.x = b.x),
run_ AS MATERIALIZED (SELECT pid, min(i) AS i, min(j) AS j, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY pid, j - i ORDER BY i) AS g FROM hit_) GROUP BY pid, j - i, g),
top_ AS (SELECT pid, max({'n': n, 'i': -i, 'j': -j}) AS b FROM run_ GROUP BY pid),
blk AS (
  SELECT prs.pid, 1::BIGINT AS alo, len(ta) + 1 AS ahi, 1::BIGINT AS blo, len(tb) + 1 AS bhi, b FROM prs JOIN top_ ON top_.pid = prs.pid
  UNION ALL
  SELECT pid, alo, ahi, blo, bhi, max({'n': n, 'i': -i, 'j': -j}) AS b FROM (
    SELECT c.pid, c.q.alo, c.q.ahi, c.q.blo, c.q.bhi, greatest(r.i, c.q.alo, c.q.blo - (r.j - r.i)) AS i, greatest(r.j, c.q.blo, c.q.alo + (r.j - r.i)) AS j,
      least(r.i + r.n, c.q.ahi, c.q.bhi - (r.j - r.i)) - greatest(r.i, c.q.alo, c.q.blo - (r.j - r.i)) AS n
    FROM (SELECT pid, unnest([{'alo': alo, 'ahi': -b.i, 'blo': blo, 'bhi': -b.j}, {'alo': b.n - b.i, 'ahi': ahi, 'blo': b.n - b.j, 'bhi': bhi}]) AS q FROM blk) c JOIN run_ r ON r.pid = c.pid)
  WHERE n > 0 GROUP BY pid, alo, ahi, blo, bhi),
ratio_ AS MATERIALIZED (SELECT prs.pid, 2.0::DOUBLE * coalesce(any_value(s.n), 0) / any_value(len(ta) + len(tb)) AS ratio FROM prs LEFT JOIN (SELECT pid, sum(b.n) AS n FROM blk GROUP BY pid) s ON s.pid = prs.pid GROUP BY prs.pid)"""
_STRUCTURAL = f"""{_TOKENS},
num AS MATERIALIZED (SELECT id, n, tok, row_number() OVER (PARTITION BY id, tok) AS nth FROM (SELECT row_number() OVER (ORDER BY k) AS id, len(t) AS n, unnest(t) AS tok FROM lists)),
ids AS MATERIALIZED (SELECT row_number() OVER (ORDER BY k) AS id, k, t FROM lists),
cand AS (SELECT a.id AS x, b.id AS y FROM num a JOIN num b ON a.tok = b.tok AND a.nth = b.nth WHERE a.id < b.id GROUP BY a.id, b.id HAVING count(*) * 20 >= 7 * (any_value(a.n) + any_value(b.n))),
both_ AS (SELECT x, y FROM cand UNION SELECT y, x FROM cand UNION SELECT a.id, b.id FROM jp JOIN ids a ON a.k = jp.x JOIN ids b ON b.k = jp.y),
prs AS MATERIALIZED (SELECT row_number() OVER () AS pid, a.k AS x, b.k AS y, a.t AS ta, b.t AS tb FROM both_ JOIN ids a ON a.id = both_.x JOIN ids b ON b.id = both_.y),{_RATIO},
sp AS (SELECT prs.x, prs.y, ratio, len(list_intersect(a.s, b.s)) AS m, len(a.s) + len(b.s) AS n FROM prs JOIN ratio_ ON ratio_.pid = prs.pid JOIN sh a ON a.k = prs.x JOIN sh b ON b.k = prs.y),
mp AS MATERIALIZED (SELECT x, y, m::DOUBLE / (n - m) AS jaccard, ratio FROM sp WHERE m::DOUBLE / (n - m) >= 0.55 OR ratio >= 0.7),
held AS (SELECT DISTINCT array_to_string(t, ' ') AS k, doc_id FROM toks WHERE len(t) > 0),
own AS (SELECT t.doc_id, t.row_idx, array_to_string(t.t, ' ') AS k FROM toks t WHERE len(t.t) > 0),
near AS (SELECT o.doc_id, o.row_idx, h.doc_id AS other FROM own o JOIN mp ON mp.x = o.k JOIN held h ON h.k = mp.y UNION SELECT doc_id, row_idx, doc_id FROM own),
keep AS MATERIALIZED (SELECT own.* FROM own JOIN (SELECT doc_id, row_idx FROM near GROUP BY doc_id, row_idx HAVING count(*) < 3) n ON n.doc_id = own.doc_id AND n.row_idx = own.row_idx),
copied AS (SELECT a.doc_id AS doc_a, a.row_idx AS row_a, b.doc_id AS doc_b, b.row_idx AS row_b, round(mp.jaccard, 3) AS jaccard, round(mp.ratio, 3) AS structural_similarity FROM keep a JOIN mp ON mp.x = a.k JOIN keep b ON b.k = mp.y WHERE a.doc_id < b.doc_id)"""


def shingle_counts(spark, d):
    # the tokens are a column of their own before they are cut into shingles, else each shingle would find them anew
    rows = similarity.document_rows(_t(spark, d, "documents")).select("doc_id", "row_idx", F.explode(F.array(X.word_tokens(F.col("text")))).alias("t"))
    return rows.select("doc_id", F.col("row_idx").cast("long").alias("row_idx"), F.size("t").cast("long").alias("n_tokens"), F.size(X.shingles(F.col("t"))).cast("long").alias("n_shingles"))


def shingle_jaccard_pairs(spark, d):
    lists = similarity.lowered_lists(_rows(spark, d))
    pairs = materialise(similarity.jaccard_pairs(lists), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("list_id"))
    some = similarity.having(lists.withColumn("name", F.xxhash64("list_id")), ids.select(F.xxhash64("list_id").alias("name")), 2 * pairs.count())
    names = some.dropDuplicates(["list_id"]).select("list_id", F.array_join(X.word_tokens(F.col("low")), " ").alias("k")).hint("merge")
    out = pairs.join(names.toDF("a", "ka"), "a").join(names.toDF("b", "kb"), "b")
    return out.select(F.least("ka", "kb").alias("tokens_a"), F.greatest("ka", "kb").alias("tokens_b"), F.round("jaccard", 3).alias("jaccard"))


def boilerplate_lines(spark, d):
    rows = _rows(spark, d)
    out = similarity.boilerplate(rows, materialise(similarity.list_pairs(rows, structural=False), "pairs"))
    return out.select("doc_id", F.col("row_idx").cast("long").alias("row_idx"), F.col("owners").cast("long").alias("owners"))


def _copied(spark, d, structural):
    out = similarity.copied_rows(_rows(spark, d), structural)
    return out.select("doc_a", F.col("row_a").cast("long").alias("row_a"), "doc_b", F.col("row_b").cast("long").alias("row_b"), "jaccard", "structural_similarity")


def copied_lines_jaccard(spark, d):
    return _copied(spark, d, False).drop("structural_similarity")


def copied_lines(spark, d):
    return _copied(spark, d, True)


def flagged_documents(spark, d):
    out = similarity.flagged(similarity.copied_rows(_rows(spark, d), structural=False))
    return out.select("doc_id", F.size("others").cast("long").alias("n_others"), F.array_join(F.transform("others", lambda x: x.cast("string")), ",").alias("others"))


_CITED = "[substr(text, 1, 24), upper(source), 'ZZ-F-' || doc_id, '', source || chr(8209) || 'x']"


def citation_grounding(spark, d):
    docs = _t(spark, d, "documents")
    cited = F.array(F.substring("text", 1, 24), F.upper("source"), F.concat(F.lit("ZZ-F-"), F.col("doc_id").cast("string")), F.lit(""), F.concat("source", F.lit("‑x")))
    hay = shaping.haystack(F.concat("text", F.lit("\n"), F.col("source")), F.lit(None).cast(f"array<{shaping.TABLE}>"))
    rows = docs.select("doc_id", cited.alias("cited"), F.explode(F.array(hay)).alias("hay"))
    rows = rows.select("doc_id", "cited", scoring.ungrounded(F.col("hay"), F.col("cited")).alias("bad"))
    g = scoring.grounding(F.col("bad"), F.col("cited"))
    return rows.select(
        "doc_id", g["cited_count"].alias("cited_count"), g["grounded_count"].alias("grounded_count"), g["grounded_fraction"].alias("grounded_fraction"), F.array_join(g["ungrounded_ids"], "|").alias("ungrounded")
    )


_NORM = "regexp_replace(regexp_replace(upper(replace(coalesce({0}, ''), 'ß', 'SS')), '[-‐‑‒–—]', '-', 'g'), ws, '', 'g')"


def normalize_ids(spark, d):
    p = _t(spark, d, "part")
    raw = F.concat(F.substring("p_type", 1, 3), F.lit("–f\n‑ "), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(" "), F.col("p_name"))
    return p.select("p_partkey", X.normal_id(raw).alias("id"))


def requirement_lines(spark, d):
    docs = _t(spark, d, "documents")
    line = F.concat(F.lit("• ABC‑F‑"), F.lpad(F.pmod("doc_id", F.lit(1000)).cast("string"), 3, "0"), F.when(F.col("doc_id") % 3 == 0, " (must) — ").when(F.col("doc_id") % 3 == 1, ": ").otherwise(" "), F.col("source"), F.lit(" shall ABC-NF-01 keep it "))
    return docs.select("doc_id", X.requirement_id(line).alias("req_id"), X.requirement_text(line).alias("requirement"), X.without_ids(line).alias("without_ids"))


def resubmissions(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("input_ord"), F.concat(F.lit("Team "), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit(" ("), (F.col("o_orderkey") % 4).cast("string"), F.lit(")"))).otherwise(""), F.when(F.col("o_orderkey") % 2 == 0, ".pdf").otherwise(".docx")).alias("filename"))
    return matching.latest_resubmission(o)


def forward_fill(spark, d):
    li = _t(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 16).alias("sheet"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("row_idx"), F.when(F.col("l_linenumber") % 3 == 1, F.col("l_orderkey")).alias("team_id"),
        F.when((F.col("l_linenumber") % 3 == 1) & (F.col("l_quantity") > 10), F.col("l_quantity")).alias("mark"), F.when(F.col("l_suppkey") % 11 > 0, F.col("l_suppkey").cast("string")).alias("member"), F.col("l_extendedprice").alias("tie"),
    )
    one = li.groupBy("sheet", "row_idx").agg(F.max("team_id").alias("team_id"), F.max("mark").alias("mark"), F.max("member").alias("member"))
    return matching.fill_teams(one, ["mark"]).select("sheet", "row_idx", "team_id", "mark", "member")


def content_match(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.col("text").alias("raw_text"))
    roster = _t(spark, d, "benchmark").select(F.col("item_id").alias("team_ord"), F.lit(0).alias("member_ord"), F.substring("text", 1, 12).alias("member"), F.substring("text", 1, 30).alias("srn"))
    return matching.content_matches(docs, roster).select("doc_id", "team_ord", "member", "confidence")


def name_overlap(spark, d):
    p, n = _t(spark, d, "part"), _t(spark, d, "nation")
    a, b = X.name_tokens(F.concat(F.col("p_type"), F.lit(" nation 1"))), X.name_tokens(F.concat_ws("_", F.col("n_name"), F.lit("nation BRASS")))
    return p.join(F.broadcast(n)).select("p_partkey", "n_nationkey", F.round(X.jaccard(a, b), 6).alias("overlap"))


def name_match(spark, d):
    names = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("file_id"), F.concat(F.col("s_name"), F.lit(" supplier")).alias("name"))
    roster = _t(spark, d, "nation").select(F.col("n_nationkey").alias("team_ord"), F.lit(0).alias("member_ord"), F.concat(F.lit("Supplier "), F.col("n_name")).alias("member"))
    return matching.best_names(names, roster, 0.3).select("file_id", "team_ord", F.round("similarity", 6).alias("similarity"))


def rubric_scores(spark, d):
    e = _t(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    value = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('"'), k, F.lit('"'))).when(F.col("event_id") % 5 == 1, F.concat(k, F.lit(".7"))).when(F.col("event_id") % 5 == 2, F.concat(F.lit('"'), k, F.lit('.5"'))).when(F.col("event_id") % 5 == 3, F.concat(F.lit("-"), k)).otherwise(k)
    per = e.select("event_id", F.lit("srs").alias("doc_type"), F.element_at(F.array(*[F.lit(c[0]) for c in rubric.CRITERIA["srs"]]), (F.pmod("user_id", F.lit(4)) + 1).cast("int")).alias("key"), value.alias("value"))
    return scoring.clamp_scores(per).select("event_id", "key", "score")


def criterion_blocks(spark, d):
    e = _t(spark, d, "events")
    docs = e.select(F.col("user_id").alias("doc_id"), F.lit("srs").alias("doc_type")).distinct()
    keys = F.element_at(F.array(*[F.lit(c[0]) for c in rubric.CRITERIA["srs"]]), (F.pmod("event_id", F.lit(3)) + 1).cast("int"))
    per = e.select(F.col("user_id").alias("doc_id"), keys.alias("key"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    scores = per.groupBy("doc_id", "key").agg(F.max("k").cast("string").alias("value"), F.concat(F.lit("seen "), F.count("*").cast("string")).alias("justification"))
    return scoring.criterion_scores(docs, scores).select("doc_id", "key", "max", "score", "justification")


def _sads(spark, d):
    keys = rubric.CRITERIA["sads"]
    li = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.element_at(F.array(*[F.lit(c[0]) for c in keys]), (F.pmod("l_partkey", F.lit(len(keys))) + 1).cast("int")).alias("key"), F.col("l_quantity"))
    per = li.groupBy("doc_id", "key").agg(F.max("l_quantity").alias("q")).select("doc_id", F.lit("sads").alias("doc_type"), "key", F.pmod(F.col("q").cast("int"), F.lit(6)).cast("string").alias("value"))
    return scoring.clamp_scores(per)


def group_subtotals(spark, d):
    scored = _sads(spark, d).groupBy("doc_id").agg(F.collect_list(F.struct("group", "score", "max")).alias("criteria"))  # a report's criteria
    return scoring.group_subtotals(scored).select("doc_id", "group", F.col("score").cast("long").alias("score"), F.col("max").cast("long").alias("max"))


def rubric_totals(spark, d):
    total = _sads(spark, d).groupBy("doc_id").agg(F.sum("score").cast("long").alias("total_score"))
    return total.select("doc_id", "total_score", F.round(F.col("total_score") * 100 / 20.0, 1).alias("percentage"), marks.score_badge(F.col("total_score") * 100 / 20.0).alias("badge"))


def diagram_kinds(spark, d):
    p = _t(spark, d, "part")
    w, h = F.col("p_size") * 20 + 150, F.pmod("p_partkey", F.lit(900)).cast("int") + 150
    guess, structure = marks.diagram_kind(w, h, F.pmod("p_partkey", F.lit(5)), F.pmod(F.col("p_size"), F.lit(4)), F.pmod("p_partkey", F.lit(41)))
    return p.select("p_partkey", guess.alias("type_guess"), structure.alias("has_structure"))


def _comparison(spark, d):
    c = _t(spark, d, "customer")
    teams = c.select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 7 > 0, F.col("c_name")).alias("team_name"), F.col("c_custkey").cast("double").alias("excel_team_id"),
        *(F.when(F.col("c_custkey") % m > 0, F.pmod(F.floor("c_acctbal"), F.lit(top)).cast("double")).alias(n) for n, m, top in (("srs_mark", 5, 11), ("test_plan_mark", 6, 9), ("sad_mark", 4, 21))),
    )
    o = _t(spark, d, "orders")
    doc_type = F.element_at(F.array(F.lit("srs"), F.lit("test_plan"), F.lit("sads")), (F.pmod("o_orderkey", F.lit(3)) + 1).cast("int"))
    subs = o.select(F.when(F.col("o_orderkey") % 13 > 0, F.col("o_custkey")).alias("team_pk"), doc_type.alias("doc_type"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("filename"), F.when(F.col("o_orderkey") % 10 > 0, F.col("o_orderdate")).alias("mtime"), F.col("o_orderkey").alias("input_ord"))
    top = F.when(doc_type == "srs", 12).when(doc_type == "test_plan", 13).otherwise(20)
    scores = o.where(F.col("o_orderkey") % 4 > 0).select(doc_type.alias("doc_type"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("source"), F.col("o_orderkey").alias("path"), F.pmod(F.floor("o_totalprice"), top).alias("total_score"), top.alias("max_total"))
    hand = spark.createDataFrame([("srs", 10.0), ("test_plan", 8.0), ("sads", 20.0)], "doc_type string, hand_max double")
    return compare.compare(subs, teams, scores, hand)


def hand_vs_system(spark, d):
    r = _comparison(spark, d)
    return r.select("doc_type", "team_pk", "name", "filename", F.col("picked_from").cast("long").alias("picked_from"), "status", "hand_score", F.col("sys_score").cast("long").alias("sys_score"), *(F.round(c, 6).alias(c) for c in ("sys_pct", "hand_pct", "sys_scaled_to_hand", "diff_scaled", "diff_pct")))


def grade_agreement(spark, d):
    a = compare.agreement(_comparison(spark, d))
    return a.select("doc_type", *(F.col(c).cast("long").alias(c) for c in ("n", "n_no_hand_mark", "n_no_score")), *(F.round(c, 6).alias(c) for c in ("mean_diff", "mean_abs_diff", "stddev_diff", "mean_diff_pct", "mean_abs_diff_pct", "stddev_diff_pct")))


def _scored_documents(spark, d):
    docs, labels = _t(spark, d, "documents"), _t(spark, d, "labels")
    j = docs.select("doc_id", "source", "lang", "n_chars").join(labels, "doc_id", "left")
    flags = F.when(F.col("toxic") == 1, F.concat(F.lit("SCORING ERROR: toxic text in "), F.col("source"), F.lit(", language "), F.col("lang"), F.lit(", to be read by a person"))).when(F.col("quality") == 0, F.col("lang")).otherwise(F.lit("None"))
    return j.select(
        "doc_id", F.concat(F.lit("Team "), F.col("source"), F.lit("-"), F.col("doc_id").cast("string")).alias("team_id"), F.when(F.col("quality").isNotNull(), F.pmod("n_chars", F.lit(201)) / 2.0).alias("percentage"),
        F.when(F.col("quality").isNotNull(), flags).alias("flags"), F.pmod("n_chars", F.lit(4)).alias("cited_count"), (F.pmod("n_chars", F.lit(11)) / 10.0).alias("grounded_fraction"),
    )


def cohort_stats(spark, d):
    c = compare.cohort(_scored_documents(spark, d))
    return c.select(*(F.col(x).cast("long").alias(x) for x in ("n", "n_scored", "n_flagged", "n_low_grounding")), "avg_percentage")


def badges(spark, d):
    s = _scored_documents(spark, d)
    label, tone = marks.grounding_badge(F.col("cited_count"), F.col("grounded_fraction"))
    return s.select("doc_id", marks.flag_tone(F.col("flags")).alias("tone"), marks.score_badge(F.col("percentage")).alias("badge"), label.alias("grounding"), tone.alias("grounding_tone"), marks.short_flags(F.col("flags")).alias("short_flags"))


def _found(only, query=""):
    return lambda spark, d: compare.search(_scored_documents(spark, d), query, only).select("doc_id", "percentage")


def latest_files(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("team"), F.col("event_id").alias("input_ord"), F.when(F.col("event_id") % 6 > 0, F.date_trunc("day", "ts")).alias("mtime"))
    return matching.latest_file(e).select("team", "input_ord", F.col("picked_from").cast("long").alias("picked_from"))


def unlabelled_documents(spark, d):
    return _t(spark, d, "documents").select("doc_id", "source").join(_t(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


def content_copies(spark, d):
    docs = _t(spark, d, "documents").select(F.col("lang").alias("doc_id"), F.col("doc_id").alias("ord"), F.col("text").cast("binary").alias("content"))
    return matching.distinct_images(docs).select(F.col("doc_id").alias("lang"), "md5", "ord", F.col("repeated_count").cast("long").alias("repeated_count"))


def split_tables(spark, d):
    e = _t(spark, d, "events")
    cells = F.transform(F.sequence(F.lit(1), (F.pmod(F.floor(F.col("event_id") / 3), F.lit(3)) + 2).cast("int")), lambda i: F.concat(F.col("event_type"), i.cast("string")))
    head = F.when(F.col("event_id") % 7 == 0, F.concat(F.array(F.lit("Req\nID")), F.slice(cells, 2, 9))).otherwise(cells)
    raw = e.select(F.col("user_id").alias("source"), F.col("event_id").alias("table_ord"), F.array(head, F.when(F.col("event_id") % 2 == 0, cells).otherwise(F.transform(cells, lambda _: F.lit(" ")))).alias("rows"))
    out = shaping.join_split_tables(raw)
    return out.select("source", "table_ord", F.size("rows").cast("long").alias("n_rows"), F.size(F.col("rows")[0]).cast("long").alias("width"))


def header_labels(spark, d):
    p = _t(spark, d, "part")
    heads = F.array(F.lit(" Req\n Id"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.col("p_brand")), F.col("p_brand"), F.lit("Requirement"), F.col("p_brand"))
    rows = F.array(heads, F.array(F.col("p_type"), F.lit(" a "), F.lit(None).cast("string"), F.col("p_name"), F.lit("z"), F.lit("long")), F.array(F.lit(" "), F.lit("")), F.array(F.lit("x")))
    t = p.select("p_partkey", shaping.shape_table(rows, page=True).alias("t"))
    return t.select("p_partkey", F.array_join("t.headers", "|").alias("headers"), F.col("t.req_id_col").alias("req_id_col"), shaping.text_header(F.col("t.headers")).alias("text_col"), F.col("t.n_data_rows").cast("long").alias("n_rows"), F.col("t.rows")[0][F.col("t.headers")[1]].alias("second"), F.col("t.rows")[1][F.col("t.headers")[3]].alias("filled"))


def upsert_by_rank(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderpriority").alias("doc_type"), F.col("o_custkey").cast("string").alias("team_id"), F.pmod("o_orderkey", F.lit(5)).alias("rank"), F.col("o_orderkey").alias("upload_ord"))
    stored = store.newest(o.limit(0), o.where(F.col("upload_ord") % 2 == 0))
    return store.newest(stored, o.where(F.col("upload_ord") % 2 == 1))


def line_counts(spark, d):
    n, _ = shaping.counts(F.col("text"), F.lit(None).cast("array<string>"))
    return _t(spark, d, "documents").select("doc_id", n.cast("long").alias("n_lines"))


def submission_texts(spark, d):
    p = _t(spark, d, "part")
    rows = F.array(F.array(F.lit("Req ID"), F.lit("Requirement")), F.array(F.col("p_brand"), F.col("p_name")), F.array(F.lit(""), F.col("p_type")))
    tables = F.array(shaping.shape_table(rows).cast(shaping.TABLE))
    return p.select("p_partkey", shaping.submission_text(F.col("p_type"), tables).alias("submission"), shaping.haystack(F.col("p_type"), tables).alias("haystack"))


def score_reports(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.lit("srs").alias("doc_type"), F.concat("source", F.lit(".docx")).alias("source"), F.col("text").alias("raw_text"), F.lit(None).cast(f"array<{shaping.TABLE}>").alias("tables"))
    reply = F.concat(F.lit('Here: {"intro_score": '), F.pmod("doc_id", F.lit(4)).cast("string"), F.lit(', "requirements_score": "'), F.pmod("doc_id", F.lit(9)).cast("string"), F.lit('", "uml_score": 1.9, "functional_requirements_found": ["ZZ-F-1", ""], "flags": '), F.when(F.col("doc_id") % 2 == 0, "null").otherwise('"late"'), F.lit("} end"))
    replies = docs.select("doc_id", F.when(F.col("doc_id") % 10 == 0, "no reply").otherwise(reply).alias("raw"), F.lit(None).cast("string").alias("error"))
    return scoring.reports(docs, replies).select("doc_id", F.col("total_score").cast("long").alias("total_score"), "percentage", "flags")


def plagiarism_report(spark, d):
    rows = _rows(spark, d)
    found = materialise(similarity.list_pairs(rows, structural=False), "pairs")
    r = similarity.report(rows, similarity.copied_rows(rows, structural=False, pairs=found), similarity.common_rows(rows, found))
    return r.select("students_checked", "common_rows_excluded", "flagged_row_pair_count", F.size("flagged_students").cast("long").alias("n_flagged_students"))


def _roster_sheets(spark, d):
    c = _t(spark, d, "customer")
    first = (F.col("c_custkey") % 3 == 1) | (F.col("c_custkey") % 7 == 0)
    cell = lambda ok, v: F.when(ok, v.cast("string"))
    cells = F.create_map(
        F.lit("Team ID"), cell(first, F.col("c_custkey").cast("double")), F.lit("Team name"), cell(first, F.col("c_name")), F.lit("Project ID"), cell(first & (F.col("c_custkey") % 2 == 0), F.col("c_nationkey").cast("double")),
        F.when(F.col("c_nationkey") % 2 == 0, "Project name").otherwise("Project Title"), cell(first, F.col("c_mktsegment")), F.lit("SRS"), cell(first & (F.col("c_custkey") % 5 > 0), F.pmod(F.floor("c_acctbal"), F.lit(11))),
        F.lit("Team members"), cell(F.col("c_custkey") % 11 > 0, F.concat(F.lit(" "), F.col("c_name"), F.lit(" m "))), F.lit("SRN"), cell(F.lit(True), F.concat(F.lit("S"), F.col("c_custkey").cast("string"))),
    )
    return c.select(F.col("c_nationkey").alias("sheet_ord"), F.concat(F.lit("section "), F.col("c_nationkey").cast("string")).alias("sheet"), (F.col("c_custkey") + 1).alias("row_idx"), cells.alias("cells"))


def roster_members(spark, d):
    r = matching.roster(_roster_sheets(spark, d))
    return r.select("section", F.col("team_ord").cast("long").alias("team_ord"), F.col("member_ord").cast("long").alias("member_ord"), "excel_team_id", "team_name", "project_id", "project_name", "srs_mark", "member", "srn")


def roster_teams(spark, d):
    teams, members = matching.relations(matching.roster(_roster_sheets(spark, d)))
    n = members.groupBy("team_pk").agg(F.count("*").alias("members"))
    return teams.join(n, teams.id == n.team_pk).select("id", "section", "team_name", "members")


def hand_maxima(spark, d):
    n = _t(spark, d, "nation")
    cell = lambda m, v: F.when(F.col("n_nationkey") % m > 0, v.cast("string"))
    cells = F.create_map(F.lit("SRS"), cell(3, F.col("n_regionkey") * 2.5), F.lit("Test Plan"), cell(5, F.col("n_nationkey")), F.lit("SAD"), F.when(F.col("n_nationkey") < 9, "20"))
    sheets = n.select(F.col("n_nationkey").alias("sheet_ord"), F.lit(1).alias("row_idx"), cells.alias("cells"))
    return compare.hand_maximum(compare.sheet_maxima(sheets))


def pdf_pages(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text", "source")
    box = lambda y0, y1: (F.lit(0.0).alias("x0"), y0.cast("double").alias("y0"), F.lit(100.0).alias("x1"), y1.cast("double").alias("y1"))
    line = lambda t, i: F.struct(F.when(i % 13 == 12, 1).otherwise(0).alias("kind"), F.array(t, F.lit(" ")).alias("spans"), *box(i * 10, i * 10 + 9))
    rows = lambda *cells: F.array(F.array(F.lit("ID"), F.lit("T")), F.array(*cells)).alias("rows")
    tables = F.array(F.struct(*box(F.lit(12), F.lit(25)), rows(F.col("doc_id").cast("string"), F.col("source"))), F.struct(*box(F.lit(24), F.lit(31)), rows(F.lit("second"), F.col("source"))))
    read = F.when(F.col("doc_id") % 3 > 0, F.array(F.struct(F.lit(0).alias("kind"), F.array(F.lit("read from a scan of "), F.col("source")).alias("spans"), *box(F.lit(0), F.lit(9)))))
    made = docs.select(F.col("doc_id").cast("string").alias("source"), F.lit(1).alias("page"), F.transform(F.split("text", "\n"), line).cast(f"array<{pages.LINE}>").alias("lines"), read.cast(f"array<{pages.LINE}>").alias("ocr_lines"), tables.cast(f"array<{pages.BOX}>").alias("tables"))
    out = pages.documents(made)
    return out.select(F.col("source").cast("long").alias("doc_id"), F.md5(F.col("raw_text").cast("binary")).alias("text_md5"), F.array_join(F.transform("raw_tables", lambda t: t[1][0]), "|").alias("tables"), F.col("ocr_pages").isNotNull().alias("ocr"))


def batch_summary(spark, d):
    docs = _t(spark, d, "documents")
    name = F.concat(F.lit("Team "), F.pmod("doc_id", F.lit(97)).cast("string"), F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit(" ("), (F.col("doc_id") % 4).cast("string"), F.lit(")"))).otherwise(""), F.lit(".docx"))
    listed = docs.select(F.col("doc_id").alias("input_ord"), name.alias("filename"))
    bad = F.col("doc_id") % 5 == 0
    decoded = docs.select(F.col("doc_id").alias("input_ord"), F.when(bad, F.lit(None)).otherwise(F.col("text")).alias("raw_text"), F.when(~bad, F.sequence(F.lit(1), F.pmod("doc_id", F.lit(3)) + 1)).alias("tables"), F.when(bad, "BadZipFile: no archive").alias("error"))
    return files.batch_summary(listed, decoded).select("input_ord", "team_id", "file", F.col("lines").cast("long").alias("lines"), F.col("tables").cast("long").alias("tables"), "skipped", "reason", "error")


def teams_with_scores(spark, d):
    docs, labels = _t(spark, d, "documents"), _t(spark, d, "labels")
    ing = docs.select(F.lit("srs").alias("doc_type"), F.col("doc_id").cast("string").alias("team_id"), F.when(F.col("doc_id") % 9 > 0, F.col("source")).alias("source"), F.when(F.col("doc_id") % 8 > 0, F.col("text")).alias("raw_text"), F.lit(None).cast(f"array<{shaping.TABLE}>").alias("tables"))
    scores = labels.select(F.lit("srs").alias("doc_type"), F.col("doc_id").cast("string").alias("team_id"), (F.col("quality") * 10 + F.col("toxic")).alias("total_score"))
    out = compare.team_listing(ing, scores, "srs")
    return out.select("team_id", "source", F.length("raw_text").cast("long").alias("n"), F.size("tables").cast("long").alias("n_tables"), F.col("score.total_score").cast("long").alias("total_score"))


def team_id_list(spark, d):
    return compare.team_ids(_t(spark, d, "orders").select(F.concat(F.lit("Team "), F.col("o_custkey").cast("string")).alias("team_id")))


def stale_scores(spark, d):
    docs = _t(spark, d, "documents").select(F.lit("srs").alias("doc_type"), F.col("doc_id").cast("string").alias("team_id"), "source")
    lab = _t(spark, d, "labels")
    none = lambda t: F.lit(None).cast(t)
    scores = lab.select(F.lit("srs").alias("doc_type"), F.col("doc_id").cast("string").alias("team_id"), F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")).alias("source"), F.lit(50.0).alias("percentage"), F.col("quality").alias("total_score"), none("string").alias("flags"), none("map<string,array<string>>").alias("extracted_ids"), none("struct<grounded_fraction:double>").alias("sanity_check"))
    return compare.with_scores(docs, scores).select("team_id", F.col("total_score").cast("long").alias("total_score"), "score_is_stale")


def missing_marks(spark, d):
    rows = _comparison(spark, d)
    both = [compare.missing(rows, s).withColumn("status", F.lit(s)) for s in ("no_hand_mark", "no_score")]
    return both[0].unionByName(both[1]).select("doc_type", "status", "n", F.md5(F.array_join("names", "|").cast("binary")).alias("names_md5"))


def _summaries(spark, d):
    s = _scored_documents(spark, d).where("percentage IS NOT NULL")
    fake = s.select("doc_id", F.pmod("doc_id", F.lit(12)).cast("int").alias("total_score"), "percentage", "flags", F.struct(F.col("grounded_fraction"), F.array().cast("array<string>").alias("ungrounded_ids")).alias("sanity_check"), F.array(F.struct(F.pmod("doc_id", F.lit(12)).cast("int").alias("score")), F.struct(F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0).alias("score"))).alias("criteria"))
    return scoring.batch_summary(fake)


def summary_parts(spark, d):
    parts = scoring.summary_parts(_summaries(spark, d))
    out = [df.select(F.lit(k).alias("part"), "doc_id", "internal_sum_mismatch", "low_grounding", "hard_error") for k, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def match_summary(spark, d):
    o = _t(spark, d, "orders")
    kind = F.element_at(F.array(F.lit("filename"), F.lit("content"), F.lit("none")), (F.pmod("o_orderkey", F.lit(3)) + 1).cast("int"))
    m = o.select(F.col("o_orderpriority").alias("doc_type"), F.when(kind != "none", F.col("o_custkey")).alias("team_ord"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("filename"), kind.alias("match_method"), (F.pmod("o_orderkey", F.lit(10)) / 10.0).alias("confidence"))
    several = matching.several_files(m).groupBy("doc_type").agg(F.count("*").alias("teams_with_several"))
    low = matching.low_confidence(m).groupBy("doc_type").agg(F.count("*").alias("low"))
    return matching.match_counts(m).join(several, "doc_type", "left").join(low, "doc_type", "left")


def counted_matches(spark, d):
    """Matches written to a table, and their totals counted on the way."""
    o = _t(spark, d, "orders")
    kind = F.element_at(F.array(F.lit("filename"), F.lit("content"), F.lit("none")), (F.pmod("o_orderkey", F.lit(3)) + 1).cast("int"))
    m = o.select(F.element_at(F.array(*(F.lit(k) for k in rubric.CRITERIA)), (F.pmod("o_custkey", F.lit(3)) + 1).cast("int")).alias("doc_type"), "o_orderkey", kind.alias("match_method"))
    return matching.put_matches(m, f"{scratch.folder(spark)}/docloom-matches-{uuid.uuid4().hex}", list(rubric.CRITERIA))


def best_name_per_file(spark, d):
    li = _t(spark, d, "lineitem")
    pairs = li.select(F.col("l_orderkey").alias("file_id"), F.col("l_suppkey").alias("team_ord"), F.col("l_linenumber").alias("member_ord"), (F.pmod("l_partkey", F.lit(11)) / 10.0).alias("similarity"))
    return matching.best_matches(pairs).select("file_id", "team_ord", "similarity")


def cited_items(spark, d):
    docs = _t(spark, d, "documents")
    ids = F.create_map(F.lit("fr"), F.array(F.col("source"), F.upper("lang")), F.lit("nfr"), F.when(F.col("doc_id") % 2 == 0, F.array("lang")).otherwise(F.array().cast("array<string>")))
    rows = docs.select("doc_id", ids.alias("extracted_ids"), F.struct(F.array("lang", F.lit("src1")).alias("ungrounded_ids")).alias("sanity_check"))
    return compare.id_chips(rows)


def sorted_rows(spark, d):
    docs = _scored_documents(spark, d).select("doc_id", "team_id", "percentage")
    best = compare.sort_rows(docs, "score", descending=True).limit(50)  # the first page of a list
    return best.select("doc_id", "percentage")


def team_labels(spark, d):
    c = _t(spark, d, "customer")
    return c.select("c_custkey", compare.label(F.when(F.col("c_custkey") % 3 == 0, " ").when(F.col("c_custkey") % 3 == 1, F.col("c_name")), F.col("c_custkey").cast("double")).alias("label"))


def image_shapes(spark, d):
    p = _t(spark, d, "part")
    size = lambda k: (F.pmod("p_partkey", F.lit(k)) + 120).cast("int")
    contour = lambda i: F.struct((F.lit(4.0) + i * F.col("p_size")).alias("area"), (F.pmod(F.col("p_partkey") + i, F.lit(5)) + 3).cast("int").alias("corners"), (F.col("p_size") % 2 == 0).alias("convex"), F.when(i % 4 > 0, F.lit(4.0) + i * 20).alias("ellipse"))
    made = p.select("p_partkey", size(371).alias("width"), size(211).alias("height"), (F.col("p_size") / 37.0).alias("edge_density"), F.pmod("p_partkey", F.lit(41)).cast("int").alias("n_lines"), F.transform(F.sequence(F.lit(0), F.lit(9)), contour).alias("contours"))
    out = images.described(made)
    return out.select("p_partkey", "edge_density", *(F.col(c).cast("long").alias(c) for c in ("n_boxes", "n_ellipses")), "type_guess")


def requirement_rows(spark, d):
    docs = _t(spark, d, "documents")
    number = F.lpad(F.pmod("doc_id", F.lit(1000)).cast("string"), 4, "0")
    text = F.concat(F.lit("Intro "), F.col("source"), F.lit("\n • ABC‑F‑"), number, F.lit(" (must) — "), F.col("source"), F.lit(" shall keep all of its "), F.col("lang"), F.lit(" records ABC-NF-01 safe \nno requirement\n"), F.when(F.col("doc_id") % 2 == 0, "XY-SEC-12: too short").otherwise("XY-SEC-12: this one is long enough"))
    cells = F.create_map(F.lit("Req ID"), F.concat(F.lit("T-"), F.col("doc_id").cast("string")), F.lit("Requirement"), F.when(F.col("doc_id") % 3 > 0, F.substring("text", 1, 60)))
    table = F.struct(F.array(F.lit("Req ID"), F.lit("Requirement")).alias("headers"), F.array(cells).alias("rows"), F.lit("Req ID").alias("req_id_col"), F.lit(1).alias("n_data_rows"))
    made = docs.select("doc_id", text.alias("raw_text"), F.array(table).cast(f"array<{shaping.TABLE}>").alias("tables"))
    return shaping.requirement_rows(shaping.with_requirement_table(made)).select("doc_id", F.col("table_idx").cast("long").alias("table_idx"), F.col("row_idx").cast("long").alias("row_idx"), "req_id", "text")


def submission_listing(spark, d):
    """The listing of submissions with their teams, in its order."""
    o, c = _t(spark, d, "orders"), _t(spark, d, "customer")
    subs = o.select(F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey")).alias("team_pk"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("filename"))
    teams = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") % 4 > 0, F.col("c_nationkey").cast("string")).alias("section"), F.when(F.col("c_custkey") % 7 > 0, F.col("c_name")).alias("team_name"))
    return store.submissions_report(subs, teams).select("team_pk", "section", "team_name", "filename")


def roster_relations(spark, d):
    """The three relations written anew and read back, submissions with their teams."""
    teams, members = matching.relations(matching.roster(_roster_sheets(spark, d)))
    subs = members.select(F.lit("srs").alias("doc_type"), F.concat("name", F.lit(".pdf")).alias("filename"), "team_pk")
    root = f"{scratch.folder(spark)}/docloom-roster-{uuid.uuid4().hex}"
    store.build_roster(teams, members, subs, root)
    t, m, s = (spark.read.parquet(f"{root}/{x}") for x in ("teams", "team_members", "submissions"))
    n = m.groupBy("team_pk").agg(F.count("*").alias("members"))
    return s.join(t.select(F.col("id").alias("team_pk"), "section", "srs_mark"), "team_pk", "left").join(n, "team_pk").select("team_pk", "section", "srs_mark", "filename", "members")


def sqlite_teams(spark, d):
    """Teams written to a SQLite file and those with a mark of 5 or more read back."""
    teams, _ = matching.relations(matching.roster(_roster_sheets(spark, d)))
    path = f"{scratch.folder(spark)}/docloom-{uuid.uuid4().hex}.db"
    sqlite.write(teams.select("id", "section", "team_name", "project_id", "srs_mark"), path, "teams")
    return sqlite.read(spark, path, "teams").where((F.col("srs_mark") >= 5) & F.col("project_id").isNotNull())


def filename_names(spark, d):
    o = _t(spark, d, "orders")
    k = F.col("o_orderkey")
    mark = F.when(k % 4 == 0, "PESU").when(k % 4 == 1, "PESU-EC PESU").when(k % 4 == 2, "pesu").otherwise(" - PESU")
    dash = F.when(k % 3 == 0, " - ").when(k % 3 == 1, "-").otherwise(" - x - ")
    name = F.concat(F.lit("SRS_"), k.cast("string"), dash, F.lit(" "), F.col("o_orderpriority"), F.lit(" "), mark, F.lit("_"), F.col("o_orderstatus"), F.lit(".pdf"))
    return o.select("o_orderkey", X.name_in_filename(name).alias("name"))


def diagram_texts(spark, d):
    p = _t(spark, d, "part")
    image = F.struct(F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("page"), F.when(F.col("p_size") % 3 == 0, F.lit(3)).alias("repeated_count"), F.lit(300).alias("width"), F.lit(200).alias("height"), F.col("p_brand").alias("type_guess"), F.pmod("p_partkey", F.lit(9)).alias("n_boxes"), F.lit(2).alias("n_ellipses"), F.col("p_size").alias("n_lines"), (F.col("p_partkey") % 5 == 0).alias("has_diagram_structure"))
    found = F.when(F.col("p_partkey") % 6 == 0, F.slice(F.array(image), 1, 0)).when(F.col("p_partkey") % 6 == 1, F.array(image, image)).otherwise(F.array(image))
    return p.select("p_partkey", scoring.diagram_evidence(found).alias("evidence"))


def prompt_texts(spark, d):
    """What prompts hold of each text, and how many fields they ask for."""
    images = "array<struct<width:int,height:int,n_boxes:int,n_ellipses:int,n_lines:int,has_diagram_structure:boolean,type_guess:string,page:int,repeated_count:int>>"
    kinds = F.array(*(F.lit(k) for k in sorted(rubric.CRITERIA)))
    docs = _t(spark, d, "documents").select("doc_id", F.element_at(kinds, (F.pmod("doc_id", F.lit(3)) + 1).cast("int")).alias("doc_type"), F.col("text").alias("raw_text"), F.lit(None).cast(f"array<{shaping.TABLE}>").alias("tables"), F.lit(None).cast(images).alias("images"))
    p = scoring.prompts(docs)
    body = F.substring_index(F.substring(F.col("prompt"), F.locate("SUBMISSION:\n", F.col("prompt")) + 12, F.length("raw_text") + 1), "\n---\nDIAGRAMS", 1)
    return p.select("doc_id", "doc_type", F.md5(F.rtrim(body, F.lit("\n")).cast("binary")).alias("text_md5"), F.regexp_count("prompt", F.lit('  "[a-z_]+_score": <')).cast("long").alias("scores"))


def cited_counts(spark, d):
    docs = _t(spark, d, "documents")
    ids = F.when(F.col("doc_id") % 4 > 0, F.create_map(F.lit("fr"), F.split("source", "")))
    return docs.select("doc_id", compare.id_count(ids, "fr").cast("long").alias("fr"), compare.id_count(ids, "nfr").cast("long").alias("nfr"))


def _first_page(key):
    def query(spark, d):
        """The first page of the list."""
        docs = _scored_documents(spark, d)
        ids = F.when(F.col("doc_id") % 3 > 0, F.create_map(F.lit("fr"), F.sequence(F.lit(1), (F.pmod("doc_id", F.lit(7)) + 1).cast("int"))))
        rows = docs.select("doc_id", "team_id", "percentage", F.when(F.col("percentage").isNotNull(), F.struct("grounded_fraction")).alias("sanity_check"), ids.alias("extracted_ids"))
        return compare.sort_rows(rows, key, descending=True).limit(50).select("doc_id")

    return query


def _uploads(spark, d):
    o = _t(spark, d, "orders")
    n = F.pmod("o_orderkey", F.lit(6))
    name = F.concat(F.lit("Team "), F.col("o_custkey").cast("string"), F.when(n > 1, F.concat(F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(""), F.when(F.col("o_orderkey") % 11 == 0, ".txt").otherwise(".pdf"))
    return o.select(F.when(F.col("o_orderkey") % 2 == 0, "srs").otherwise("sads").alias("doc_type"), name.alias("source"), F.col("o_orderkey").alias("upload_ord"), F.pmod("o_custkey", F.lit(3)).alias("day"))


def upload_history(spark, d):
    """Uploads of three runs merged one after the other, and when each stored row held."""
    table = f"{scratch.folder(spark)}/docloom-uploads-{uuid.uuid4().hex}"
    named = uploads.with_team(_uploads(spark, d).withColumn("day", F.pmod("upload_ord", F.lit(3)))).where("NOT rejected").drop("rejected")
    for day in range(3):
        uploads.merge(spark, table, named.where(F.col("day") == day), day)
    return uploads.history(spark, table).select("doc_type", "team_id", "rank", "upload_ord", "run_from", "run_to")


def upload_decisions(spark, d):
    """Uploads as a stream of one batch, and what became of each."""
    root = f"{scratch.folder(spark)}/docloom-stream-{uuid.uuid4().hex}"
    _uploads(spark, d).write.parquet(f"{root}/box")
    key, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(key, uploads.ROCKS_DB)
    try:
        stream = spark.readStream.schema(spark.read.parquet(f"{root}/box").schema).parquet(f"{root}/box")
        uploads.decisions(stream).writeStream.option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).format("parquet").option("path", f"{root}/out").start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.parquet(f"{root}/out").select("doc_type", "team_id", "upload_ord", "rank", "status")


def model_replies(spark, d):
    """Replies of a stand-in for a model, stored by prompt, and asked for again: the second time all are there."""
    root = f"{scratch.folder(spark)}/docloom-replies-{uuid.uuid4().hex}"
    prompted = _t(spark, d, "documents").select("doc_id", F.concat(F.col("source"), F.lit(" "), F.col("lang")).alias("prompt"))
    replies.ask(prompted, _stand_in, root, attempts=1)
    return replies.ask(prompted, _stand_in, root, attempts=1).select("doc_id", "raw", "error")


def _stand_in(prompt: str) -> str:
    if prompt.endswith("fr"):
        raise ValueError(f"no reply to {prompt}")
    return prompt[::-1]


def pdf_ranges(spark, d):
    """Texts as files of 8 lines a page, decoded by ranges of 3 pages."""
    docs = _t(spark, d, "documents")
    given = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"), F.col("text").cast("binary").alias("content"))
    paged, _ = files.decode_pages(given, files.PdfDecoder(_page_count, _page_lines), 3)
    n = paged.groupBy("source").agg(F.max("page").cast("long").alias("pages"))
    out = pages.documents(paged.drop("images")).join(n, "source")
    return out.select(F.regexp_replace("source", "[.]pdf$", "").cast("long").alias("doc_id"), "pages", F.md5(F.col("raw_text").cast("binary")).alias("text_md5"))


def _page_count(content: bytes) -> int:
    return content.count(b"\n") // 8 + 1


def _page_lines(content: bytes, first: int, last: int) -> list[dict]:
    lines = content.decode().split("\n")
    return [{"lines": [(0, [t], 0.0, 10.0 * y, 90.0, 10.0 * y + 9) for y, t in enumerate(lines[8 * k - 8 : 8 * k])]} for k in range(first, last + 1)]


FLAGSHIP = shingle_jaccard_pairs

QUERIES = {
    "line_rows": line_rows, "shingle_counts": shingle_counts, "shingle_jaccard_pairs": shingle_jaccard_pairs, "boilerplate_lines": boilerplate_lines, "copied_lines_jaccard": copied_lines_jaccard,
    "copied_lines": copied_lines, "flagged_documents": flagged_documents, "citation_grounding": citation_grounding, "normalize_ids": normalize_ids, "requirement_lines": requirement_lines,
    "resubmissions": resubmissions, "forward_fill": forward_fill, "content_match": content_match, "name_overlap": name_overlap, "name_match": name_match, "rubric_scores": rubric_scores,
    "group_subtotals": group_subtotals, "rubric_totals": rubric_totals, "diagram_kinds": diagram_kinds, "hand_vs_system": hand_vs_system, "grade_agreement": grade_agreement,
    "cohort_stats": cohort_stats, "badges": badges, "filter_unscored": _found("unscored"), "filter_flagged": _found("flagged"), "filter_lowscore": _found("lowscore", " TEAM src1 "),
    "latest_files": latest_files, "unlabelled_documents": unlabelled_documents, "content_copies": content_copies, "split_tables": split_tables, "header_labels": header_labels,
    "upsert_by_rank": upsert_by_rank, "line_counts": line_counts, "submission_texts": submission_texts, "score_reports": score_reports, "criterion_blocks": criterion_blocks,
    "plagiarism_report": plagiarism_report, "roster_members": roster_members, "roster_teams": roster_teams, "hand_maxima": hand_maxima, "pdf_pages": pdf_pages, "batch_summary": batch_summary,
    "teams_with_scores": teams_with_scores, "team_id_list": team_id_list, "stale_scores": stale_scores, "missing_marks": missing_marks, "summary_parts": summary_parts, "match_summary": match_summary,
    "best_name_per_file": best_name_per_file, "cited_items": cited_items, "sorted_rows": sorted_rows, "team_labels": team_labels, "image_shapes": image_shapes,
    "requirement_rows": requirement_rows, "submission_listing": submission_listing, "roster_relations": roster_relations, "sqlite_teams": sqlite_teams, "filename_names": filename_names,
    "diagram_texts": diagram_texts, "prompt_texts": prompt_texts, "cited_counts": cited_counts, "sorted_grounded": _first_page("grounded"), "sorted_idcount": _first_page("idcount:fr"),
    "upload_history": upload_history, "upload_decisions": upload_decisions, "model_replies": model_replies, "pdf_ranges": pdf_ranges, "counted_matches": counted_matches,
}

_CRIT = lambda d: "(VALUES " + ", ".join(f"({k}, '{c[0]}', {c[2]}, {repr(c[3]) if c[3] else 'NULL'})" for k, c in enumerate(rubric.CRITERIA[d])) + ") c(ord, key, top, grp)"
_SADS = f"""sads AS (SELECT q.doc_id, c.key, c.grp, c.top, greatest(0, least(c.top, (trunc(q.q)::BIGINT % 6))) AS score
  FROM (SELECT l_orderkey AS doc_id, l_partkey % 9 AS ord, max(l_quantity) AS q FROM lineitem GROUP BY ALL) q JOIN {_CRIT("sads")} ON c.ord = q.ord)"""
_SCORED = """s AS (
  SELECT d.doc_id, 'Team ' || d.source || '-' || d.doc_id AS team_id, CASE WHEN l.quality IS NOT NULL THEN (n_chars % 201) / 2.0::DOUBLE END AS percentage,
    CASE WHEN l.quality IS NOT NULL THEN CASE WHEN l.toxic = 1 THEN 'SCORING ERROR: toxic text in ' || d.source || ', language ' || d.lang || ', to be read by a person' WHEN l.quality = 0 THEN d.lang ELSE 'None' END END AS flags,
    n_chars % 4 AS cited, (n_chars % 11) / 10.0::DOUBLE AS fraction
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
_TONE = "CASE WHEN flags IS NULL OR flags IN ('', 'None') THEN NULL WHEN starts_with(flags, 'SCORING ERROR') THEN 'red' ELSE 'amber' END"
_COMPARE = """t AS (
  SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 7 > 0 THEN c_name END, 'team #' || c_custkey) AS name,
    CASE WHEN c_custkey % 5 > 0 THEN ((floor(c_acctbal)::BIGINT % 11) + 11) % 11 END::DOUBLE AS srs, CASE WHEN c_custkey % 6 > 0 THEN ((floor(c_acctbal)::BIGINT % 9) + 9) % 9 END::DOUBLE AS test_plan,
    CASE WHEN c_custkey % 4 > 0 THEN ((floor(c_acctbal)::BIGINT % 21) + 21) % 21 END::DOUBLE AS sads FROM customer),
h AS (SELECT id, name, unnest(['srs', 'test_plan', 'sads']) AS doc_type, unnest([srs, test_plan, sads]) AS hand FROM t),
f AS (SELECT *, ['srs', 'test_plan', 'sads'][o_orderkey % 3 + 1] AS doc_type, 'f' || o_orderkey AS filename, CASE WHEN o_orderkey % 10 > 0 THEN epoch(o_orderdate) ELSE -1 END AS mtime FROM orders),
p AS (SELECT *, count(*) OVER w AS picked, row_number() OVER (w ORDER BY mtime DESC, o_orderkey) AS rn FROM f WHERE o_orderkey % 13 > 0 WINDOW w AS (PARTITION BY o_custkey, doc_type)),
m AS (SELECT * FROM (VALUES ('srs', 10.0::DOUBLE, 12), ('test_plan', 8.0::DOUBLE, 13), ('sads', 20.0::DOUBLE, 20)) v(doc_type, hmax, smax)),
j AS (SELECT p.doc_type, p.o_custkey AS team_pk, h.name, p.filename, p.picked AS picked_from, h.hand AS hand_score, CASE WHEN p.o_orderkey % 4 > 0 THEN floor(p.o_totalprice)::BIGINT % m.smax END AS sys_score, m.hmax, m.smax
  FROM p JOIN h ON h.id = p.o_custkey AND h.doc_type = p.doc_type JOIN m ON m.doc_type = p.doc_type WHERE rn = 1),
k AS (SELECT *, CASE WHEN hand_score IS NULL THEN 'no_hand_mark' WHEN sys_score IS NULL THEN 'no_score' ELSE 'ok' END AS status FROM j),
r AS (SELECT *, CASE WHEN status = 'ok' THEN sys_score * 100.0::DOUBLE / smax END AS sp, CASE WHEN status = 'ok' THEN hand_score * 100.0::DOUBLE / hmax END AS hp, CASE WHEN status = 'ok' THEN sys_score * (hmax / smax) END AS sc FROM k)"""

_ROSTER = """r AS (SELECT c_nationkey AS sheet_ord, 'section ' || c_nationkey AS section, c_custkey AS row_idx, c_custkey % 3 = 1 OR c_custkey % 7 = 0 AS head, * FROM customer WHERE c_custkey % 11 > 0),
g AS (SELECT *, count(*) FILTER (head) OVER (PARTITION BY section ORDER BY row_idx) AS team_ord FROM r),
f AS (SELECT *, first_value(c_custkey) OVER w::DOUBLE AS excel_team_id, first_value(c_name) OVER w AS team_name, first_value(CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END) OVER w::DOUBLE AS project_id,
  first_value(c_mktsegment) OVER w AS project_name, first_value(CASE WHEN c_custkey % 5 > 0 THEN ((floor(c_acctbal)::BIGINT % 11) + 11) % 11 END) OVER w::DOUBLE AS srs_mark, c_name || ' m' AS member, 'S' || c_custkey AS srn
  FROM g WHERE team_ord > 0 WINDOW w AS (PARTITION BY section, team_ord ORDER BY row_idx))"""

_NAMES = f"""prs AS MATERIALIZED (
  SELECT row_number() OVER () AS pid, s_suppkey AS file_id, n_nationkey AS team_ord, n_name AS member, string_split(s_name || ' supplier', '') AS ta, string_split('Supplier ' || n_name, '') AS tb,
    list_distinct(list_filter(regexp_split_to_array(upper(s_name || ' supplier'), '[^A-Z]+'), lambda x: length(x) > 1)) AS na, list_distinct(list_filter(regexp_split_to_array(upper('Supplier ' || n_name), '[^A-Z]+'), lambda x: length(x) > 1)) AS nb
  FROM supplier, nation),{_RATIO}"""

_UPLOADS = """u AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'srs' ELSE 'sads' END AS doc_type, 'Team ' || o_custkey AS team_id, CASE WHEN o_orderkey % 6 > 1 THEN o_orderkey % 6 ELSE -1 END AS rank, o_orderkey AS upload_ord, o_orderkey % 3 AS day, o_orderkey % 11 = 0 AS bad FROM orders)"""

ORACLES = {
    "requirement_rows": f"""WITH w AS (SELECT {_WS} AS ws), r AS (
  SELECT doc_id, 0 AS table_idx, 0 AS row_idx, 'T-' || doc_id AS req_id, {_STRIP.format("regexp_replace(coalesce(CASE WHEN doc_id % 3 > 0 THEN substr(text, 1, 60) END, ''), '(?i)\\b[a-z]{2,6}-(?:F|NF|SEC)-[0-9]{2,4}\\b', '', 'g')")} AS text, ws FROM documents, w
  UNION ALL SELECT doc_id, 1, 0, 'ABC-F-' || lpad((doc_id % 1000)::VARCHAR, 4, '0'), source || ' shall keep all of its ' || lang || ' records  safe', ws FROM documents, w
  UNION ALL SELECT doc_id, 1, 1, 'XY-SEC-12', CASE WHEN doc_id % 2 = 0 THEN 'too short' ELSE 'this one is long enough' END, ws FROM documents, w)
SELECT doc_id, table_idx::BIGINT AS table_idx, row_idx::BIGINT AS row_idx, req_id, text FROM r WHERE len(list_filter(regexp_split_to_array(text, ws || '+'), lambda x: x <> '')) >= 5""",
    "submission_listing": """SELECT o.team_pk, section, team_name, filename FROM (SELECT CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END AS team_pk, 'f' || o_orderkey AS filename FROM orders) o
LEFT JOIN (SELECT c_custkey AS id, CASE WHEN c_nationkey % 4 > 0 THEN c_nationkey::VARCHAR END AS section, CASE WHEN c_custkey % 7 > 0 THEN c_name END AS team_name FROM customer) c ON c.id = o.team_pk""",
    "roster_relations": f"""WITH {_ROSTER}, i AS (SELECT *, dense_rank() OVER (ORDER BY sheet_ord, team_ord) AS team_pk FROM f)
SELECT team_pk, section, first_value(srs_mark) OVER (PARTITION BY team_pk ORDER BY row_idx) AS srs_mark, member || '.pdf' AS filename, count(*) OVER (PARTITION BY team_pk) AS members FROM i""",
    "sqlite_teams": f"""WITH {_ROSTER}, i AS (SELECT *, dense_rank() OVER (ORDER BY sheet_ord, team_ord) AS id FROM f)
SELECT id, any_value(section) AS section, any_value(team_name) AS team_name, any_value(project_id) AS project_id, any_value(srs_mark) AS srs_mark FROM i WHERE srs_mark >= 5 AND project_id IS NOT NULL GROUP BY id""",
    "filename_names": """WITH n AS (SELECT o_orderkey, o_orderkey % 4 AS m, o_orderkey % 3 AS s, o_orderpriority FROM orders)
SELECT o_orderkey, CASE WHEN m = 2 THEN NULL WHEN m = 3 THEN '' WHEN s = 1 THEN NULL ELSE o_orderpriority || CASE WHEN m = 1 THEN ' PESU-EC' ELSE '' END END AS name FROM n""",
    "diagram_texts": """WITH p AS (SELECT *, CASE p_partkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS n, CASE WHEN p_size % 2 = 0 THEN ' page ' || p_size ELSE ' in the text' END || CASE WHEN p_size % 3 = 0 THEN ' and 2 more times' ELSE '' END || '; ' || p_brand || '; ' || (p_partkey % 9) || ' boxes, 2 ovals, ' || p_size || ' lines; ' || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'not ' END || 'drawn like a diagram' AS line FROM part)
SELECT p_partkey, CASE n WHEN 0 THEN 'No pictures large enough for a diagram. Drawings may be vector graphics: go by captions, and say so in the flags.' ELSE 'Shapes were counted by machine; what they mean was not looked at.' || chr(10) || '- #1' || line || CASE WHEN n = 2 THEN chr(10) || '- #2' || line ELSE '' END END AS evidence FROM p""",
    "prompt_texts": f"""SELECT doc_id, t.doc_type, md5(rtrim(text, chr(10))) AS text_md5, t.scores FROM documents JOIN (VALUES {', '.join(f"({k}, '{name}', {len(rubric.CRITERIA[name])})" for k, name in enumerate(sorted(rubric.CRITERIA)))}) t(k, doc_type, scores) ON t.k = doc_id % 3""",
    "cited_counts": "SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN length(source) END AS fr, NULL::BIGINT AS nfr FROM documents",
    "sorted_grounded": f"WITH {_SCORED} SELECT doc_id FROM s ORDER BY CASE WHEN percentage IS NOT NULL THEN fraction ELSE -1 END DESC, lower(team_id) LIMIT 50",
    "sorted_idcount": f"WITH {_SCORED} SELECT doc_id FROM s ORDER BY CASE WHEN doc_id % 3 > 0 THEN doc_id % 7 + 1 ELSE -1 END DESC, lower(team_id) LIMIT 50",
    "upload_history": f"""WITH {_UPLOADS}, m AS (SELECT *, max(rank) OVER (PARTITION BY doc_type, team_id ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (PARTITION BY doc_type, team_id, day ORDER BY rank DESC, upload_ord) AS rn FROM u WHERE NOT bad),
k AS (SELECT *, day + 1 AS run_from FROM m WHERE rn = 1 AND (before IS NULL OR rank > before))
SELECT doc_type, team_id, rank, upload_ord, run_from, lead(run_from) OVER (PARTITION BY doc_type, team_id ORDER BY run_from) - 1 AS run_to FROM k""",
    "upload_decisions": f"""WITH {_UPLOADS}, m AS (SELECT *, max(CASE WHEN NOT bad THEN rank END) OVER (PARTITION BY doc_type, team_id ORDER BY upload_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM u)
SELECT doc_type, team_id, upload_ord, rank, CASE WHEN bad THEN 'rejected' WHEN rank <= before THEN 'skipped' ELSE 'stored' END AS status FROM m""",
    "counted_matches": f"""SELECT doc_type, count(*) AS total, count(*) FILTER (o_orderkey % 3 = 0) AS matched, count(*) FILTER (o_orderkey % 3 = 1) AS content_fallback, count(*) FILTER (o_orderkey % 3 = 2) AS unmatched
FROM orders JOIN (VALUES {', '.join(f"({k}, '{name}')" for k, name in enumerate(rubric.CRITERIA))}) t(k, doc_type) ON t.k = o_custkey % 3 GROUP BY doc_type""",
    "model_replies": "SELECT doc_id, CASE WHEN lang <> 'fr' THEN reverse(source || ' ' || lang) END AS raw, CASE WHEN lang = 'fr' THEN 'no reply to ' || source || ' ' || lang END AS error FROM documents",
    "pdf_ranges": f"""WITH w AS (SELECT {_WS} AS ws), l AS (SELECT doc_id, i, {_STRIP.format("t")} AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), w)
SELECT doc_id, ((max(i) - 1) // 8 + 1)::BIGINT AS pages, md5(coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (t <> ''), '')) AS text_md5 FROM l GROUP BY doc_id""",
    "line_rows": f"WITH {_LINES} SELECT doc_id, row_idx, text FROM rows_",
    "shingle_counts": f"WITH {_TOKENS} SELECT doc_id, row_idx, len(t)::BIGINT AS n_tokens, coalesce(len(s), 0)::BIGINT AS n_shingles FROM toks LEFT JOIN sh ON sh.k = array_to_string(toks.t, ' ')",
    "shingle_jaccard_pairs": f"WITH {_TOKENS} SELECT x AS tokens_a, y AS tokens_b, round(jaccard, 3) AS jaccard FROM jp WHERE x < y",
    "boilerplate_lines": f"WITH {_COMMON} SELECT doc_id, row_idx, owners FROM common",
    "copied_lines_jaccard": f"WITH {_COPIED} SELECT * FROM copied",
    "copied_lines": f"WITH RECURSIVE {_STRUCTURAL} SELECT * FROM copied",
    "name_match": f"""WITH RECURSIVE {_NAMES},
s AS (SELECT file_id, team_ord, member, greatest(len(list_intersect(na, nb))::DOUBLE / (len(na) + len(nb) - len(list_intersect(na, nb))), ratio) AS similarity FROM prs JOIN ratio_ ON ratio_.pid = prs.pid)
SELECT file_id, team_ord, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.3 QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY similarity DESC, team_ord) = 1""",
    "flagged_documents": f"""WITH {_COPIED}, u AS (SELECT doc_a AS doc_id, doc_b AS o FROM copied UNION SELECT doc_b, doc_a FROM copied)
SELECT doc_id, count(*) AS n_others, string_agg(o::VARCHAR, ',' ORDER BY o) AS others FROM u GROUP BY doc_id""",
    "citation_grounding": f"""WITH w AS (SELECT {_WS} AS ws), c AS (SELECT doc_id, {_NORM.format("text || chr(10) || source")} AS hay, {_CITED} AS cited, ws FROM documents, w),
b AS (SELECT doc_id, cited, list_filter(cited, lambda x: NOT contains(hay, {_NORM.format("x")})) AS bad FROM c)
SELECT doc_id, 5::BIGINT AS cited_count, (5 - len(bad))::BIGINT AS grounded_count, round((5 - len(bad)) / 5.0::DOUBLE, 3) AS grounded_fraction, array_to_string(bad, '|') AS ungrounded FROM b""",
    "normalize_ids": f"WITH w AS (SELECT {_WS} AS ws) SELECT p_partkey, {_NORM.format('substr(p_type, 1, 3) || chr(8211) || chr(102) || chr(10) || chr(8209) || chr(32) || lpad(p_size::VARCHAR, 3, chr(48)) || chr(32) || p_name')} AS id FROM part, w",
    "requirement_lines": """WITH l AS (SELECT doc_id, '• ABC‑F‑' || lpad((doc_id % 1000)::VARCHAR, 3, '0') || CASE doc_id % 3 WHEN 0 THEN ' (must) — ' WHEN 1 THEN ': ' ELSE ' ' END || source || ' shall ABC-NF-01 keep it ' AS line FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN 'ABC-F-' || lpad((doc_id % 1000)::VARCHAR, 3, '0') END AS req_id,
  CASE WHEN doc_id % 3 < 2 THEN trim(regexp_extract(line, '^•\\s*[A-Z]+‑F‑[0-9]+\\s*(?:\\([^)]*\\)\\s*)?[—:]\\s*(.+)$', 1)) END AS requirement, trim(regexp_replace(line, '\\b[A-Za-z]{2,6}-(?:F|NF|SEC)-[0-9]{2,4}\\b', '', 'g')) AS without_ids FROM l""",
    "resubmissions": """WITH f AS (SELECT o_orderkey AS input_ord, 'Team ' || o_custkey AS team, o_orderkey % 4 AS n, 'Team ' || o_custkey || CASE WHEN o_orderkey % 4 > 0 THEN ' (' || (o_orderkey % 4) || ')' ELSE '' END || CASE WHEN o_orderkey % 2 = 0 THEN '.pdf' ELSE '.docx' END AS filename FROM orders),
r AS (SELECT *, CASE WHEN n > 0 THEN n ELSE -1 END AS rank FROM f), p AS (SELECT *, row_number() OVER w AS rn, first_value(filename) OVER w AS best FROM r WINDOW w AS (PARTITION BY team ORDER BY rank DESC, input_ord DESC))
SELECT input_ord, filename, team, rank::BIGINT AS rank, rn = 1 AS kept, CASE WHEN rn > 1 THEN 'superseded by ' || best END AS reason FROM p""",
    "forward_fill": """WITH l AS (SELECT l_orderkey % 16 AS sheet, l_orderkey * 100 + l_linenumber AS row_idx, max(CASE WHEN l_linenumber % 3 = 1 THEN l_orderkey END) AS team_id,
  max(CASE WHEN l_linenumber % 3 = 1 AND l_quantity > 10 THEN l_quantity END) AS mark, max(CASE WHEN l_suppkey % 11 > 0 THEN l_suppkey::VARCHAR END) AS member FROM lineitem GROUP BY 1, 2),
o AS (SELECT *, count(team_id) OVER (PARTITION BY sheet ORDER BY row_idx) AS ord FROM l),
f AS (SELECT sheet, row_idx, ord, member, first_value(team_id) OVER w AS team_id, first_value(mark) OVER w AS mark FROM o WHERE ord > 0 WINDOW w AS (PARTITION BY sheet, ord ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT sheet, row_idx, team_id, mark, member FROM f WHERE member IS NOT NULL""",
    "content_match": f"""WITH w AS (SELECT {_WS} AS ws), d AS (SELECT doc_id, upper(replace(text, 'ß', 'SS')) AS up FROM documents),
r AS (SELECT item_id, substr(text, 1, 12) AS member, upper(replace(substr(text, 1, 30), 'ß', 'SS')) AS srn, {_STRIP.format("substr(text, 1, 12)")} AS nm FROM benchmark, w),
m AS (SELECT doc_id, item_id, member, CASE WHEN contains(up, srn) THEN 1.0 ELSE 0.95 END::DOUBLE AS confidence FROM d, r WHERE contains(up, srn) OR (length(nm) >= 4 AND contains(up, upper(replace(nm, 'ß', 'SS')))))
SELECT doc_id, item_id AS team_ord, member, confidence FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, item_id) = 1""",
    "name_overlap": """WITH a AS (SELECT p_partkey, list_distinct(list_filter(regexp_split_to_array(upper(p_type || ' nation 1'), '[^A-Z]+'), lambda x: length(x) > 1)) AS t FROM part),
b AS (SELECT n_nationkey, list_distinct(list_filter(regexp_split_to_array(upper(n_name || '_nation BRASS'), '[^A-Z]+'), lambda x: length(x) > 1)) AS t FROM nation)
SELECT p_partkey, n_nationkey, round(len(list_intersect(a.t, b.t))::DOUBLE / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))), 6) AS overlap FROM a, b""",
    "rubric_scores": f"""WITH e AS (SELECT event_id, user_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events)
SELECT event_id, c.key, greatest(0, least(top, CASE event_id % 5 WHEN 2 THEN 0 WHEN 3 THEN -k ELSE k END))::INTEGER AS score FROM e JOIN {_CRIT("srs")} ON c.ord = e.user_id % 4""",
    "group_subtotals": f'WITH {_SADS} SELECT doc_id, grp AS "group", sum(score)::BIGINT AS score, sum(top)::BIGINT AS "max" FROM sads GROUP BY doc_id, grp',
    "rubric_totals": f"WITH {_SADS}, t AS (SELECT doc_id, sum(score)::BIGINT AS total_score FROM sads GROUP BY doc_id) SELECT doc_id, total_score, round(total_score * 100 / 20.0::DOUBLE, 1) AS percentage, CASE WHEN total_score >= 15 THEN 'green' WHEN total_score >= 10 THEN 'amber' ELSE 'red' END AS badge FROM t",
    "diagram_kinds": "WITH p AS (SELECT p_partkey, (p_size * 20 + 150)::DOUBLE / (p_partkey % 900 + 150) AS a, p_partkey % 5 AS b, p_size % 4 AS e, p_partkey % 41 AS l FROM part) SELECT p_partkey, CASE WHEN e >= 2 AND b <= 2 THEN '{}' WHEN a >= 1.3 AND b >= 1 AND l >= 30 THEN '{}' WHEN b >= 3 AND l >= 10 THEN '{}' WHEN NOT (b >= 2 OR e >= 2 OR l >= 15) THEN '{}' ELSE '{}' END AS type_guess, (b >= 2 OR e >= 2 OR l >= 15) AS has_structure FROM p".format(*marks.DIAGRAM_KINDS),
    "hand_vs_system": f"""WITH {_COMPARE} SELECT doc_type, team_pk, name, filename, picked_from, status, hand_score, sys_score, round(sp, 6) AS sys_pct, round(hp, 6) AS hand_pct, round(sc, 6) AS sys_scaled_to_hand,
round(CASE WHEN status = 'ok' THEN hand_score - sc END, 6) AS diff_scaled, round(hp - sp, 6) AS diff_pct FROM r""",
    "grade_agreement": f"""WITH {_COMPARE}, g AS (SELECT doc_type, count(sc) AS n, count(*) FILTER (status = 'no_hand_mark') AS n_no_hand_mark, count(*) FILTER (status = 'no_score') AS n_no_score, avg(hand_score - sc) AS a,
avg(abs(hand_score - sc)) AS b, stddev_pop(hand_score - sc) AS c, max(hmax) AS h FROM r GROUP BY doc_type)
SELECT doc_type, n, n_no_hand_mark, n_no_score, round(a, 6) AS mean_diff, round(b, 6) AS mean_abs_diff, round(c, 6) AS stddev_diff, round(a * 100 / h, 6) AS mean_diff_pct, round(b * 100 / h, 6) AS mean_abs_diff_pct, round(c * 100 / h, 6) AS stddev_diff_pct FROM g""",
    "cohort_stats": f"WITH {_SCORED} SELECT count(*) AS n, count(percentage) AS n_scored, count({_TONE}) AS n_flagged, count(*) FILTER (cited > 0 AND fraction < 0.8) AS n_low_grounding, round(avg(percentage), 1) AS avg_percentage FROM s",
    "badges": f"""WITH {_SCORED} SELECT doc_id, {_TONE} AS tone, CASE WHEN percentage IS NULL THEN 'neutral' WHEN percentage >= 75 THEN 'green' WHEN percentage >= 50 THEN 'amber' ELSE 'red' END AS badge,
CASE WHEN cited = 0 THEN 'n/a' ELSE floor(fraction * 100 + 0.5)::BIGINT || '%' END AS grounding, CASE WHEN cited = 0 THEN 'neutral' WHEN floor(fraction * 100 + 0.5) >= 90 THEN 'green' WHEN floor(fraction * 100 + 0.5) >= 70 THEN 'amber' ELSE 'red' END AS grounding_tone,
CASE WHEN length(flags) > 60 THEN substr(flags, 1, 57) || '...' ELSE flags END AS short_flags FROM s""",
    "filter_unscored": f"WITH {_SCORED} SELECT doc_id, percentage FROM s WHERE percentage IS NULL",
    "filter_flagged": f"WITH {_SCORED} SELECT doc_id, percentage FROM s WHERE {_TONE} IS NOT NULL",
    "filter_lowscore": f"WITH {_SCORED} SELECT doc_id, percentage FROM s WHERE contains(lower(team_id), 'team src1') AND percentage < 50",
    "latest_files": """WITH e AS (SELECT user_id AS team, event_id AS input_ord, CASE WHEN event_id % 6 > 0 THEN epoch(date_trunc('day', ts)) ELSE -1 END AS m FROM events)
SELECT team, input_ord, count(*) OVER (PARTITION BY team) AS picked_from FROM e QUALIFY row_number() OVER (PARTITION BY team ORDER BY m DESC, input_ord) = 1""",
    "unlabelled_documents": "SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)",
    "content_copies": "SELECT lang, md5(text) AS md5, min(doc_id) AS ord, CASE WHEN count(*) > 1 THEN count(*) END AS repeated_count FROM documents WHERE text IS NOT NULL GROUP BY lang, md5(text)",
    "split_tables": """WITH e AS (SELECT user_id AS source, event_id AS ord, event_id // 3 % 3 + 2 AS width, event_id % 7 = 0 AS head, event_id % 2 = 0 AS full_ FROM events),
f AS (SELECT *, head OR lag(width) OVER w IS DISTINCT FROM width AS fresh FROM e WINDOW w AS (PARTITION BY source ORDER BY ord)),
g AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY source ORDER BY ord) AS island FROM f)
SELECT source, min(ord) AS table_ord, sum(CASE WHEN fresh THEN 2 WHEN full_ THEN 2 ELSE 1 END)::BIGINT AS n_rows, any_value(width)::BIGINT AS width FROM g GROUP BY source, island""",
    "header_labels": """WITH p AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN ['Req' || chr(10) || ' Id', 'Column 2', p_brand, 'Requirement', p_brand || ' (2)'] ELSE ['Req' || chr(10) || ' Id', p_brand, p_brand || ' (2)', 'Requirement', p_brand || ' (3)'] END AS h FROM part)
SELECT p_partkey, array_to_string(h, '|') AS headers, h[1] AS req_id_col, 'Requirement' AS text_col, 2::BIGINT AS n_rows, 'a' AS second, '' AS filled FROM p""",
    "upsert_by_rank": """SELECT o_orderpriority AS doc_type, o_custkey::VARCHAR AS team_id, o_orderkey % 5 AS rank, o_orderkey AS upload_ord FROM orders
QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderkey % 5 DESC, o_orderkey % 2, o_orderkey) = 1""",
    "line_counts": "SELECT doc_id, (len(string_split(text, chr(10))) - CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 1 ELSE 0 END)::BIGINT AS n_lines FROM documents",
    "submission_texts": f"""WITH w AS (SELECT {_WS} AS ws) SELECT p_partkey, p_type || chr(10) || '[table: Req ID, Requirement]' || chr(10) || 'Req ID: ' || p_brand || ' | Requirement: ' || p_name || chr(10) || 'Requirement: ' || p_type AS submission,
{_NORM.format("p_type || chr(10) || p_brand || chr(10) || p_name || chr(10) || p_type")} AS haystack FROM part, w""",
    "score_reports": """WITH s AS (SELECT doc_id, doc_id % 10 = 0 AS bad, least(2, doc_id % 4) + least(6, doc_id % 9) + 1 AS total, doc_id % 2 = 0 AS quiet FROM documents)
SELECT doc_id, CASE WHEN bad THEN 0 ELSE total END::BIGINT AS total_score, round(CASE WHEN bad THEN 0 ELSE total END * 100 / 12.0::DOUBLE, 1) AS percentage,
CASE WHEN bad THEN 'SCORING ERROR: no JSON object in reply' ELSE CASE WHEN quiet THEN '' ELSE 'late | ' END || 'UNGROUNDED CITATIONS: 1/2 cited item(s) not found verbatim in extracted text (e.g. ZZ-F-1) -- possible hallucination, verify manually.' END AS flags FROM s""",
    "criterion_blocks": f"""WITH e AS (SELECT user_id AS doc_id, event_id % 3 AS ord, json_extract_string(props, '$.k')::INTEGER AS k FROM events),
s AS (SELECT doc_id, ord, max(k) AS k, count(*) AS n FROM e GROUP BY ALL)
SELECT d.doc_id, c.key, c.top AS "max", greatest(0, least(c.top, coalesce(s.k, 0)))::INTEGER AS score, coalesce('seen ' || s.n, '') AS justification FROM (SELECT DISTINCT doc_id FROM e) d CROSS JOIN {_CRIT("srs")} LEFT JOIN s ON s.doc_id = d.doc_id AND s.ord = c.ord""",
    "plagiarism_report": f"""WITH {_COPIED} SELECT (SELECT count(DISTINCT doc_id) FROM toks) AS students_checked, (SELECT count(*) FROM common) AS common_rows_excluded, (SELECT count(*) FROM copied) AS flagged_row_pair_count,
(SELECT count(*) FROM (SELECT doc_a FROM copied UNION SELECT doc_b FROM copied)) AS n_flagged_students""",
    "roster_members": f"""WITH {_ROSTER} SELECT section, team_ord, row_number() OVER (PARTITION BY section, team_ord ORDER BY row_idx) - 1 AS member_ord, excel_team_id, team_name, project_id, project_name, srs_mark, member, srn FROM f""",
    "roster_teams": f"""WITH {_ROSTER}, t AS (SELECT sheet_ord, section, team_ord, any_value(team_name) AS team_name, count(*) AS members FROM f GROUP BY ALL)
SELECT row_number() OVER (ORDER BY sheet_ord, team_ord) AS id, section, team_name, members FROM t""",
    "hand_maxima": """WITH n AS (SELECT n_nationkey AS o, CASE WHEN n_nationkey % 3 > 0 THEN n_regionkey * 2.5 END::DOUBLE AS a, CASE WHEN n_nationkey % 5 > 0 THEN n_nationkey END::DOUBLE AS b, CASE WHEN n_nationkey < 9 THEN 20 END::DOUBLE AS c FROM nation)
SELECT 'srs' AS doc_type, arg_max(a, o) AS hand_max FROM n UNION ALL SELECT 'test_plan', arg_max(b, o) FROM n UNION ALL SELECT 'sads', arg_max(c, o) FROM n""",
    "pdf_pages": f"""WITH w AS (SELECT {_WS} AS ws), l AS (SELECT doc_id, source, i - 1 AS i, {_STRIP.format("t")} AS t FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), w),
k AS (SELECT * FROM l WHERE t <> '' AND i % 13 <> 12),
c AS (SELECT d.doc_id, d.source, coalesce(sum(length(k.t)), 0) AS n, max(CASE WHEN k.i IN (1, 2) THEN 1 ELSE 0 END) AS one, max(CASE WHEN k.i = 3 THEN 1 ELSE 0 END) AS two,
  coalesce(string_agg(k.t, chr(10) ORDER BY k.i) FILTER (k.i NOT IN (1, 2, 3)), '') AS body FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id, d.source),
o AS (SELECT *, n < 40 AND doc_id % 3 > 0 AND length(trim('read from a scan of ' || source)) > n AS ocr FROM c)
SELECT doc_id, md5(CASE WHEN ocr THEN 'read from a scan of ' || source ELSE body END) AS text_md5, CASE WHEN ocr THEN '' ELSE concat_ws('|', CASE WHEN one = 1 THEN doc_id::VARCHAR END, CASE WHEN two = 1 THEN 'second' END) END AS tables, ocr FROM o""",
    "batch_summary": """WITH f AS (SELECT doc_id AS input_ord, 'Team ' || (doc_id % 97) AS team_id, doc_id % 4 AS n, 'Team ' || (doc_id % 97) || CASE WHEN doc_id % 4 > 0 THEN ' (' || (doc_id % 4) || ')' ELSE '' END || '.docx' AS file,
  len(string_split(text, chr(10))) - CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 1 ELSE 0 END AS lines FROM documents),
p AS (SELECT *, row_number() OVER w AS rn, first_value(file) OVER w AS best FROM f WINDOW w AS (PARTITION BY team_id ORDER BY CASE WHEN n > 0 THEN n ELSE -1 END DESC, input_ord DESC)),
q AS (SELECT *, rn = 1 AND input_ord % 5 > 0 AS ok FROM p)
SELECT input_ord, team_id, file, CASE WHEN ok THEN lines END::BIGINT AS lines, CASE WHEN ok THEN input_ord % 3 + 1 END::BIGINT AS tables, CASE WHEN rn > 1 THEN true END AS skipped, CASE WHEN rn > 1 THEN 'superseded by ' || best END AS reason,
CASE WHEN rn = 1 AND input_ord % 5 = 0 THEN 'BadZipFile: no archive' END AS error FROM q""",
    "teams_with_scores": """SELECT d.doc_id::VARCHAR AS team_id, CASE WHEN d.doc_id % 9 > 0 THEN d.source ELSE d.doc_id::VARCHAR END AS source, CASE WHEN d.doc_id % 8 > 0 THEN length(d.text) ELSE 0 END::BIGINT AS n, 0::BIGINT AS n_tables, (l.quality * 10 + l.toxic)::BIGINT AS total_score
FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "team_id_list": "SELECT DISTINCT 'Team ' || o_custkey AS team_id FROM orders",
    "stale_scores": "SELECT d.doc_id::VARCHAR AS team_id, l.quality::BIGINT AS total_score, l.doc_id IS NOT NULL AND 'src' || (d.doc_id % 20) <> d.source AS score_is_stale FROM documents d LEFT JOIN labels l USING (doc_id)",
    "missing_marks": f"""WITH {_COMPARE} SELECT doc_type, status, count(*) AS n, md5(string_agg(name, '|' ORDER BY name)) AS names_md5 FROM r WHERE status <> 'ok' GROUP BY doc_type, status""",
    "summary_parts": f"""WITH {_SCORED}, b AS (SELECT doc_id, doc_id % 10 = 0 AS internal_sum_mismatch, fraction < 0.8 AS low_grounding, starts_with(flags, 'SCORING ERROR') AS hard_error FROM s WHERE percentage IS NOT NULL)
SELECT 'clean' AS part, * FROM b WHERE NOT coalesce(hard_error, false) UNION ALL SELECT 'mismatched', * FROM b WHERE low_grounding OR internal_sum_mismatch UNION ALL SELECT 'failed', * FROM b WHERE hard_error""",
    "match_summary": """WITH m AS (SELECT o_orderpriority AS doc_type, ['filename', 'content', 'none'][o_orderkey % 3 + 1] AS k, o_custkey, (o_orderkey % 10) / 10.0::DOUBLE AS c FROM orders),
v AS (SELECT doc_type, count(*) AS teams_with_several FROM (SELECT doc_type, o_custkey FROM m WHERE k <> 'none' GROUP BY ALL HAVING count(*) > 1) GROUP BY doc_type)
SELECT doc_type, count(*) AS total, count(*) FILTER (k = 'filename') AS matched, count(*) FILTER (k = 'content') AS content_fallback, count(*) FILTER (k = 'none') AS unmatched, count(DISTINCT CASE WHEN k <> 'none' THEN o_custkey END) AS teams,
any_value(teams_with_several) AS teams_with_several, nullif(count(*) FILTER (k <> 'none' AND c < 0.85), 0) AS low FROM m LEFT JOIN v USING (doc_type) GROUP BY doc_type""",
    "best_name_per_file": """WITH p AS (SELECT l_orderkey AS file_id, l_suppkey AS team_ord, l_linenumber AS m, (l_partkey % 11) / 10.0::DOUBLE AS similarity FROM lineitem)
SELECT file_id, team_ord, similarity FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY similarity DESC, team_ord, m) AS rn FROM p WHERE similarity > 0) WHERE rn = 1 AND similarity >= 0.6""",
    "cited_items": """WITH c AS (SELECT doc_id, lang, 'fr' AS category, unnest([source, upper(lang)]) AS item FROM documents UNION ALL SELECT doc_id, lang, 'nfr', lang FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, category, item, item = lang OR item = 'src1' AS ungrounded FROM c""",
    "sorted_rows": f"WITH {_SCORED} SELECT doc_id, percentage FROM s ORDER BY coalesce(percentage, -1) DESC, lower(team_id) LIMIT 50",
    "team_labels": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN c_name ELSE 'team #' || c_custkey END AS label FROM customer",
    "image_shapes": """WITH p AS (SELECT p_partkey, p_partkey % 371 + 120 AS w, p_partkey % 211 + 120 AS h, p_size, p_partkey % 41 AS l FROM part),
c AS (SELECT *, unnest(range(0, 10)) AS i FROM p WHERE least(w, h) >= 150),
m AS (SELECT *, 4.0::DOUBLE + i * p_size AS area, (p_partkey + i) % 5 + 3 AS corners, CASE WHEN i % 4 > 0 THEN 4.0::DOUBLE + i * 20 END AS ell FROM c),
n AS (SELECT p_partkey, w, h, l, p_size, count(*) FILTER (area >= w * h * 0.0005 AND corners = 4 AND p_size % 2 = 0) AS b, count(*) FILTER (area >= w * h * 0.0005 AND corners > 5 AND area / ell > 0.7 AND area / ell < 1.3) AS e FROM m GROUP BY ALL)
SELECT p_partkey, round(p_size / 37.0::DOUBLE, 4) AS edge_density, b AS n_boxes, e AS n_ellipses, CASE WHEN e >= 2 AND b <= 2 THEN '{}' WHEN w::DOUBLE / h >= 1.3 AND b >= 1 AND l >= 30 THEN '{}' WHEN b >= 3 AND l >= 10 THEN '{}' WHEN NOT (b >= 2 OR e >= 2 OR l >= 15) THEN '{}' ELSE '{}' END AS type_guess FROM n""".format(*marks.DIAGRAM_KINDS),
}
