"""Rosters, resubmissions and the teams that submissions belong to."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import blocks
from docloom.functions import text as X
from docloom.operators import overlap
from docloom.sources import store
from docloom.sources.scratch import materialise

NAME_MATCH, CONTENT_MATCH, LOW_CONFIDENCE = 0.6, 0.95, 0.85
MIN_NAME = 4


def fill_teams(sheet: DataFrame, fields: list[str], team: str = "team_id", of: tuple[str, ...] = ("sheet",)) -> DataFrame:
    """sheet (sheet, row_idx, team, fields..., member) with team and fields of the row that began the team, nulls among them.

    Rows before a sheet's first team, and rows without a member, are left out. of: the columns that tell sheets apart.
    """
    over = W.partitionBy(*of).orderBy("row_idx")
    numbered = sheet.withColumn("team_ord", F.count(F.col(team)).over(over)).where("team_ord > 0")
    first = W.partitionBy(*of, "team_ord").orderBy("row_idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    filled = numbered.select(*of, "row_idx", "team_ord", *(F.first(F.col(c)).over(first).alias(c) for c in (team, *fields)), "member")
    return filled.where(F.coalesce(X.strip(F.col("member")), F.lit("")) != "")


#: Columns of a roster sheet by the names of the team table; of several headings the first that a sheet has counts.
TEAM_COLUMNS = {
    "team_name": ["Team name"], "project_id": ["Project ID"], "project_name": ["Project name", "Project Title"], "srs_mark": ["SRS"], "test_plan_mark": ["Test Plan"],
    "sad_mark": ["SAD"], "test_cases_mark": ["Test Cases"], "impl_mark": ["Implementation total + demo"], "overall_total": ["Overall total"],
}
_TEXTS = ("team_name", "project_name")


def roster(sheets: DataFrame) -> DataFrame:
    """Members of all teams of roster sheets (sheet_ord, sheet, row_idx, cells by heading, and filename if there are several files): section, team and member order, the team's fields, member and srn.

    Row 1 holds maximum marks and is left out. Rows without a member neither begin a team nor belong to one. A team's fields
    are those of its first row. Marks and numbers that aren't any are null. Sheets are told apart by file and place, whatever
    their names.
    """
    cell = lambda h: F.try_element_at("cells", F.lit(h))
    held = lambda hs: F.coalesce(*(cell(h) for h in hs))
    fields = [(held(hs) if c in _TEXTS else held(hs).try_cast("double")).alias(c) for c, hs in TEAM_COLUMNS.items()]
    of = ("filename",) if "filename" in sheets.columns else ()
    rows = sheets.where((F.col("row_idx") >= 2) & cell("Team members").isNotNull()).select(
        *of, "sheet_ord", "sheet", "row_idx", cell("Team ID").try_cast("double").alias("excel_team_id"), *fields, X.strip(cell("Team members")).alias("member"), cell("SRN").alias("srn")
    )
    one = (*of, "sheet_ord", "sheet")
    filled = fill_teams(rows, list(TEAM_COLUMNS), "excel_team_id", one).join(rows.select(*one, "row_idx", "srn"), [*one, "row_idx"])
    member_ord = F.row_number().over(W.partitionBy(*one, "team_ord").orderBy("row_idx")) - 1
    return filled.select(*of, "sheet_ord", F.col("sheet").alias("section"), "team_ord", member_ord.alias("member_ord"), "excel_team_id", *TEAM_COLUMNS, "member", "srn")


def relations(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(teams, team_members) of roster(): teams are numbered from 1 through all files and sheets, members carry their team's number."""
    of = [c for c in ("filename", "sheet_ord", "section", "team_ord") if c in members.columns]
    first = members.where("member_ord = 0").withColumn("id", F.row_number().over(W.orderBy(*of)).cast("long"))  # a row a team
    teams = first.select("id", "section", "excel_team_id", *TEAM_COLUMNS)
    return teams, members.join(first.select("id", *of), of).select(F.col("id").alias("team_pk"), F.col("member").alias("name"), "srn")


def latest_resubmission(files: DataFrame) -> DataFrame:
    """files (input_ord, filename) with team, rank, kept and reason: of a team the highest rank stays, of equals the last."""
    team, rank = X.resubmission(X.stem(F.col("filename")))
    order = W.partitionBy("team").orderBy(F.col("rank").desc(), F.col("input_ord").desc())
    best = F.first("filename").over(order)
    out = files.withColumn("team", team).withColumn("rank", rank).withColumn("place", F.row_number().over(order)).withColumn("best", best)
    return out.withColumn("kept", F.col("place") == 1).withColumn("reason", F.when(F.col("place") > 1, F.concat(F.lit("superseded by "), F.col("best")))).drop("place", "best")


def latest_file(files: DataFrame, team: str = "team") -> DataFrame:
    """The newest file of each team by mtime; a missing mtime is oldest, of equals the first stays."""
    order = W.partitionBy(team).orderBy(F.col("mtime").desc_nulls_last(), "input_ord")
    return files.withColumn("picked_from", F.count("*").over(W.partitionBy(team))).withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def name_pairs(names: DataFrame, members: DataFrame, least: float = NAME_MATCH) -> DataFrame:
    """(name, member, similarity): distinct names and members whose similarity is at least `least`, above 0.

    The similarity is the larger of the Jaccard similarity of name tokens and the ratio of the characters; 0 without tokens on
    either side. Pairs meet on tokens or on characters, numbered by how often they have come before: a ratio of r needs a
    common share of r / 2 of both lengths. Only what such joins leave is compared.
    """
    num = round(least * 1000)
    character = F.transform(F.sequence(F.lit(1), F.length("s")), lambda i: F.substring(F.col("s"), i, F.lit(1)))
    numbered = F.transform(F.array(F.array_sort(character)), lambda cs: F.transform(cs, lambda c, i: F.xxhash64(c, i - F.array_position(cs, c))))[0]

    def sides(df: DataFrame, text: str) -> DataFrame:
        distinct = df.where(F.col(text).isNotNull()).select(F.col(text).alias("s")).distinct().withColumn("t", X.name_tokens(F.col("s"))).where(F.size("t") > 0)
        return materialise(distinct.select(F.unhex(F.md5("s")).alias("id"), "s", "t", F.array_distinct(F.transform("t", lambda x: F.xxhash64(x))).alias("w"), F.array_distinct(numbered).alias("c")), "names")

    a, b = sides(names, "name"), sides(members, "member")
    sets = lambda df, items: df.select("id", F.col(items).alias("items"))
    near = overlap.near(sets(a, "w"), num, 1000 + num, sets(b, "w")).union(overlap.near(sets(a, "c"), num, 2000, sets(b, "c"))).distinct()
    both = near.join(a.select(F.col("id").alias("a"), F.col("s").alias("name"), F.col("t").alias("ta")), "a").join(b.select(F.col("id").alias("b"), F.col("s").alias("member"), F.col("t").alias("tb")), "b")
    scored = both.select("name", "member", X.jaccard(F.col("ta"), F.col("tb")).alias("overlap"), blocks.character_ratio("name", "member").alias("ratio"))
    return scored.select("name", "member", F.greatest("overlap", "ratio").alias("similarity")).where((F.col("similarity") >= least) & (F.col("similarity") > 0))


def best_names(names: DataFrame, roster: DataFrame, least: float = NAME_MATCH) -> DataFrame:
    """(file_id, team_ord, member_ord, member, similarity): the best of roster (team_ord, member_ord, member) for each of names (file_id, name).

    The highest similarity wins, then the first in the roster; only from least on. A similarity of 1 is one of equal tokens,
    so names that have such a member are looked up, and only the rest are searched. Names and members are taken once each,
    however many files and roster rows have them.
    """
    key = lambda c: F.array_join(F.array_sort(X.name_tokens(F.col(c))), " ")
    entry = F.struct("team_ord", "member_ord", "member")
    entries = roster.where(F.col("member").isNotNull()).withColumn("key", key("member")).where("key <> ''")
    asked = names.where(F.col("name").isNotNull()).withColumn("key", key("name")).where("key <> ''").select("file_id", "name", "key")
    equal = entries.groupBy("key").agg(F.min(entry).alias("e"))
    known = asked.join(equal, "key").select("file_id", F.lit(1.0).alias("similarity"), "e")
    rest = asked.join(equal, "key", "left_anti")
    first = entries.groupBy("member").agg(F.min(entry).alias("e"))
    found = name_pairs(rest, entries, least).join(first, "member")
    best = found.groupBy("name").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "e")).alias("x"))
    near = rest.join(best, "name").select("file_id", (-F.col("x.s")).alias("similarity"), F.col("x.e").alias("e"))
    return known.unionByName(near).select("file_id", "e.team_ord", "e.member_ord", "e.member", "similarity")


def best_matches(pairs: DataFrame, least: float = NAME_MATCH) -> DataFrame:
    """The best of pairs (file_id, team_ord, member_ord, similarity, ...) of each file: highest similarity, then first in the roster; only above 0 and from least on."""
    order = W.partitionBy("file_id").orderBy(F.col("similarity").desc(), "team_ord", "member_ord")
    return pairs.where("similarity > 0").withColumn("place", F.row_number().over(order)).where((F.col("place") == 1) & (F.col("similarity") >= least)).drop("place")


#: Bytes of the grams that patterns are found by, the longest that a pattern has; shorter patterns are found by all their bytes.
GRAMS = [8, 4, 3, 2, 1]
#: Bits of the table of grams (a power of two) that texts are checked against before anything is joined; it goes with the plan, so it has one size.
GRAM_BITS = 1 << 20


def _gram(data: Column, at: Column, q: int) -> Column:
    return F.xxhash64(F.substring(data, at, F.lit(q)))


def _anchored(patterns: DataFrame) -> DataFrame:
    """(pattern, q, gram, offset): each pattern (binary) with the hash of the gram of q bytes that the fewest patterns have, and its place in it."""
    q = F.coalesce(*(F.when(F.octet_length("pattern") >= n, n) for n in GRAMS))
    each = patterns.withColumn("q", q).withColumn("offset", F.explode(F.sequence(F.lit(1), F.octet_length("pattern") - F.col("q") + 1)))
    hashed = each.withColumn("gram", F.coalesce(*(F.when(F.col("q") == n, _gram(F.col("pattern"), F.col("offset"), n)) for n in GRAMS)))
    held = hashed.groupBy("q", "gram").agg(F.count("*").alias("held"))
    best = hashed.join(held, ["q", "gram"]).groupBy("pattern", "q").agg(F.min(F.struct("held", "gram", "offset")).alias("x"))
    return best.select("pattern", "q", "x.gram", "x.offset")


def occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, and all columns of patterns): the patterns (pattern string) that each of docs (doc_id, text) has anywhere in it, once or more often.

    Each pattern is found by one gram of its bytes, the one that the fewest patterns have. A table of GRAM_BITS bits says for
    each place of a text whether a gram may stand there; what passes is joined on it, with the bytes around, and compared. Texts
    aren't shuffled. Empty and null patterns are in no text. The table has one size; many more patterns than bits let more
    places pass and change no result.
    """
    some = patterns.select(F.col("pattern").cast("binary").alias("pattern")).where(F.octet_length("pattern") > 0).distinct()
    anchored = materialise(_anchored(some), "patterns")
    mask = GRAM_BITS - 1
    bits = anchored.select("q", F.col("gram").bitwiseAND(mask).alias("at")).distinct()
    words = bits.groupBy("q", F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    tables: dict[int, list[int]] = {}
    for r in words.collect():  # GRAM_BITS / 64 for each length of grams at most
        tables.setdefault(r.q, [0] * (GRAM_BITS // 64))[r.word] = r.bits
    longest = anchored.agg(F.max(F.octet_length("pattern"))).first()[0] or 0
    found = docs.select("doc_id", F.lit(None).cast("string").alias("pattern")).limit(0)
    for q, table in tables.items():
        data = docs.select("doc_id", F.col("text").cast("binary").alias("data")).where(F.octet_length("data") >= q)
        at = data.withColumn("at", F.explode(F.sequence(F.lit(1), F.octet_length("data") - q + 1))).withColumn("gram", _gram(F.col("data"), F.col("at"), q))
        low = F.col("gram").bitwiseAND(mask)
        word = F.get(F.lit(np.array(table, np.int64)), F.shiftright(low, 6).cast("int"))
        passed = at.where(F.getbit(word, low.bitwiseAND(63).cast("int")) == 1)
        first = F.greatest(F.col("at") - (longest - q), F.lit(1))
        around = passed.select("doc_id", "gram", (F.col("at") - first + 1).alias("at"), F.substring("data", first, F.lit(2 * longest - q)).alias("around"))
        met = around.join(anchored.where(F.col("q") == q), "gram")
        start = F.col("at") - F.col("offset") + 1
        hit = (start >= 1) & (F.substring(F.col("around"), start, F.octet_length("pattern")) == F.col("pattern"))
        found = found.unionByName(met.where(hit).select("doc_id", F.col("pattern").cast("string").alias("pattern")))
    return found.distinct().join(patterns, "pattern").select("doc_id", *patterns.columns)


def content_matches(docs: DataFrame, roster: DataFrame) -> DataFrame:
    """docs (doc_id, raw_text) matched to the first roster entry whose srn (confidence 1) or else full name (0.95) its text has."""
    name = X.strip(F.col("member"))
    entry = F.struct("team_ord", "member_ord", "member")
    by = lambda kind, ok, pattern: roster.where(ok).select(F.lit(kind).alias("kind"), F.upper(pattern).alias("pattern"), entry.alias("e"))
    # of the entries with one number, or one name, the first counts
    patterns = by(0, F.col("srn") != "", F.col("srn")).unionByName(by(1, F.length(name) >= MIN_NAME, name)).groupBy("kind", "pattern").agg(F.min("e").alias("e"))
    hits = occurrences(docs.select("doc_id", F.upper("raw_text").alias("text")), patterns)
    best = hits.groupBy("doc_id").agg(F.min(F.struct("kind", "e")).alias("x"))
    return best.select("doc_id", "x.e.team_ord", "x.e.member", F.when(F.col("x.kind") == 0, 1.0).otherwise(CONTENT_MATCH).alias("confidence"))


def resolve(files: DataFrame, roster: DataFrame) -> DataFrame:
    """files (file_id, filename, raw_text) with team_ord, member, match_method (filename, content, none) and confidence.

    File names go first; texts are searched only for the rest.
    """
    named = files.select("file_id", X.name_in_filename(F.col("filename")).alias("name"))
    by_name = best_names(named, roster).select("file_id", "team_ord", "member", F.col("similarity").alias("confidence"), F.lit("filename").alias("match_method"))
    rest = files.join(by_name, "file_id", "left_anti")
    by_text = content_matches(rest.select(F.col("file_id").alias("doc_id"), "raw_text"), roster).select(F.col("doc_id").alias("file_id"), "team_ord", "member", "confidence", F.lit("content").alias("match_method"))
    found = files.select("file_id", "filename").join(by_name.unionByName(by_text), "file_id", "left")
    return found.withColumn("match_method", F.coalesce("match_method", F.lit("none"))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def match_counts(matches: DataFrame) -> DataFrame:
    """Per doc_type: total, matched by filename, by content, unmatched, and distinct teams."""
    m = F.col("match_method")
    return matches.groupBy("doc_type").agg(
        F.count("*").alias("total"), F.count_if(m == "filename").alias("matched"), F.count_if(m == "content").alias("content_fallback"),
        F.count_if(m == "none").alias("unmatched"), F.countDistinct("team_ord").alias("teams"),
    )


def put_matches(matches: DataFrame, path: str, doc_types: list[str]) -> DataFrame:
    """Writes matches (doc_type, match_method, ...) by doc_type and gives the totals of match_counts() for doc_types, counted in the pass that writes."""
    m, kind = F.col("match_method"), F.col("doc_type")
    parts = {"total": F.lit(True), "matched": m == "filename", "content_fallback": m == "content", "unmatched": m == "none"}
    seen = store.put_counted(matches, path, "doc_type", **{f"{k}_{part}": F.count_if((kind == d) & ok) for k, d in enumerate(doc_types) for part, ok in parts.items()})
    rows = [(d, *(seen[f"{k}_{part}"] for part in parts)) for k, d in enumerate(doc_types)]  # a row for each of doc_types
    return matches.sparkSession.createDataFrame(rows, f"doc_type string, {', '.join(f'{part} long' for part in parts)}")


def several_files(matches: DataFrame) -> DataFrame:
    """Teams with more than one file of a doc_type, and the sorted names."""
    out = matches.where("team_ord IS NOT NULL").groupBy("doc_type", "team_ord").agg(F.sort_array(F.collect_list("filename")).alias("filenames"))
    return out.where(F.size("filenames") > 1)


def low_confidence(matches: DataFrame) -> DataFrame:
    return matches.where((F.col("confidence") < LOW_CONFIDENCE) & (F.col("match_method") != "none"))


def distinct_images(images: DataFrame) -> DataFrame:
    """images (doc_id, ord, content) without copies in a document: the first stays, repeated_count says how often it occurs if more than once."""
    keyed = images.where(F.col("content").isNotNull()).withColumn("md5", F.md5("content"))
    out = keyed.groupBy("doc_id", "md5").agg(F.min("ord").alias("ord"), F.count("*").alias("n"))
    return out.select("doc_id", "md5", "ord", F.when(F.col("n") > 1, F.col("n")).alias("repeated_count"))
