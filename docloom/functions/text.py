"""Text expressions. Whitespace is Unicode's as Python's str has it, not Java's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace class, dashes, bullets, requirement markers, aliases.
WS = r"[\s\p{Z}\x1c-\x1f\x85]"
NOT_WS = r"[^\s\p{Z}\x1c-\x1f\x85]"
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
DASHES = "-‐‑‒–—"
_BULLETS = "•●▪"
_LINE_ENDS = "[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
ID_HEADERS = ["reqid", "requirementid", "id"]
TEXT_HEADERS = ["requirement", "requirement(shall...)", "requirementshort"]
SHINGLE = 5


def held(value: Column, body) -> Column:
    """body(value) with value taken once, however often body names it: Spark takes an expression anew for each mention, and inside lambdas for each element."""
    return F.transform(F.array(value), body)[0]


def strip(s: Column) -> Column:
    return F.btrim(s, F.lit(WHITESPACE))


def lines(s: Column) -> Column:
    """Lines without their ends; none for an empty text, no empty last line. Null stays null."""
    one = F.replace(s, F.lit("\r\n"), F.lit("\n"))
    # a last end of line is cut off before, so that it begins no line
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(one, f"(?s){_LINE_ENDS}\\z", ""), _LINE_ENDS, -1))


def normal_header(h: Column) -> Column:
    return F.regexp_replace(F.lower(h), WS, "")


def fold_dashes(s: Column) -> Column:
    return F.regexp_replace(s, f"[{DASHES}]", "-")


def normal_id(s: Column) -> Column:
    """Upper case, one kind of dash, no whitespace; null is the empty id."""
    return F.regexp_replace(fold_dashes(F.upper(F.coalesce(s, F.lit("")))), WS, "")


# Inline requirement ids and whole requirement lines.
INLINE_ID = r"(?iU)\b[A-Za-z]{2,6}-(?:F|NF|SEC)-\d{2,4}\b"


def without_ids(s: Column) -> Column:
    """Drops inline requirement ids (ASCII hyphens only) and strips."""
    bare = F.when(s.contains("-"), F.regexp_replace(s, INLINE_ID, "")).otherwise(s)
    return strip(bare)


# Fixed value. Groups: id, requirement. (?d): only \n ends a line for the dot.
REQUIREMENT_LINE = rf"(?d)^(?:[{_BULLETS}]|{WS})*([A-Za-z]{{2,8}}[{DASHES}](?:F|NF|SEC|SO|SR)[{DASHES}]\p{{Nd}}{{2,4}}){WS}*(?:\([^)]*\){WS}*)?[{DASHES}:]{WS}*(.+)$"


def requirement_id(line: Column) -> Column:
    """Id of a requirement line with plain dashes, else null."""
    return F.nullif(fold_dashes(F.regexp_extract(line, REQUIREMENT_LINE, 1)), F.lit(""))


def requirement_text(line: Column) -> Column:
    return F.nullif(strip(F.regexp_extract(line, REQUIREMENT_LINE, 2)), F.lit(""))


def name_tokens(name: Column) -> Column:
    """Distinct upper-case runs of A-Z longer than one letter."""
    return F.array_distinct(F.filter(F.split(F.upper(F.coalesce(name, F.lit(""))), "[^A-Z]+"), lambda t: F.length(t) > 1))


def name_in_filename(filename: Column, mark: str = "PESU") -> Column:
    """What stands between the last " - " before the last mark and that mark; null without either."""
    head = F.regexp_extract(filename, f"(?s)^(.*){mark}", 1)
    return F.when(filename.contains(mark) & head.contains(" - "), strip(F.substring_index(head, " - ", -1)))


def word_tokens(s: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9]+"), "")


def shingles(tokens: Column, k: int = SHINGLE) -> Column:
    """Distinct runs of k tokens; all tokens as one if there are fewer; none for none."""
    n = F.size(tokens)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.concat_ws(" ", F.slice(tokens, i, k)))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def resubmission(stem: Column) -> tuple[Column, Column]:
    """(team, rank) of a file stem: "X (2)" is rank 2 of X, without a number the rank is -1. One suffix is taken off."""
    pattern = rf"(?s)^(.*?){WS}*\((\p{{Nd}}+)\)$"
    rank = F.regexp_extract(stem, pattern, 2)
    return F.when(rank != "", F.regexp_extract(stem, pattern, 1)).otherwise(stem), F.when(rank != "", rank.try_cast("bigint")).otherwise(F.lit(-1).cast("bigint"))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(filename: Column) -> Column:
    return F.regexp_replace(filename, r"(?s)(.)\.[^.]*$", "$1")


def suffix(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"(?s).(\.[^.]*)$", 1))
