"""Line dedup by site-relative frequency.

A page's lines are its text between tags, without scripts, styles and comments. For each host, the pages that contain a
line are divided by the host's pages; lines above RATIO are boilerplate and are dropped from the host's pages. A line of one
page only is no repetition and stays (MIN_PAGES), so that a host with a single page isn't emptied. A host can have at most
(lines per page) / RATIO such lines, so they fit one array per host. Few of them are broadcast; else pages are joined with
them by host, hosts with more than SPLIT_PAGES pages by host and a part of their pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import materialise, table

RATIO, MIN_PAGES = 0.3, 2
#: Pages of a host that one part of the join holds, about.
SPLIT_PAGES = 20_000
#: Hashes (8 bytes each) of dropped lines that are broadcast at most; beyond it the pages are joined by a shuffle.
MAX_BROADCAST_HASHES = 500_000
_HIDDEN = "(?is)<script[^<>]*>.*?</script>|<style[^<>]*>.*?</style>|<!--.*?-->"
_TAG = "<[^<>]*>"
_HOST = "^[^:/?#]+://([^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; "" if it has none or is null."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 2))


def lines_of(html: Column) -> Column:
    """Trimmed lines with any text, in order; none for null."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, "\n"), _TAG, "\n")
    return F.filter(F.transform(F.split(text, "[\r\n]+"), lambda x: F.btrim(x, F.lit(" \t"))), lambda x: x != "")


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, pages, hashes): each host's pages and the xxhash64 of its boilerplate lines."""
    rows = pages.select(host_of(F.col("url")).alias("host"), F.array_distinct(F.transform(lines_of(F.col("html")), lambda x: F.xxhash64(x))).alias("lines"))
    totals = rows.groupBy("host").agg(F.count("*").alias("pages"))
    counts = rows.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    # totals are a row a host; a host with very many lines is one that AQE splits on the other side
    high = counts.join(totals, "host").where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return high.groupBy("host").agg(F.max("pages").alias("pages"), F.collect_set("line").alias("hashes"))


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages with host, lines and kept (the lines that stay, in order).

    Pages without a host share the host "". A null html has no lines. A line counts once per page, however often it is
    repeated there. Repeated rows are pages of their own. A tag that isn't closed is text; a very long html is cut into lines
    like any other. Columns of pages with those names are replaced. An empty table gives no rows.
    """
    cols = [c for c in pages.columns if c not in ("host", "lines", "kept") and not c.startswith("__")]
    found = materialise(boilerplate(pages, ratio, min_pages), "boilerplate")
    size = found.agg(F.sum(F.size("hashes") + 4)).first()[0] or 0
    rows = pages.select(*cols, host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines"))
    if size <= MAX_BROADCAST_HASHES:
        joined = rows.join(F.broadcast(found.select(F.col("host").alias("__host"), "hashes")), rows.host == F.col("__host"), "left")
    else:
        # the parts of a large host; hosts of over SPLIT_PAGES pages are few enough for a broadcast
        parts = F.ceil(F.col("pages") / F.lit(SPLIT_PAGES)).cast("int")
        large = F.broadcast(found.where(F.col("pages") > SPLIT_PAGES).select(F.col("host").alias("__large"), parts.alias("__parts")))
        each = found.select(F.col("host").alias("__host"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("__part"), "hashes")
        draw = F.xxhash64("url", "html")
        rows = pages.select(*cols, host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines"), draw.alias("__draw"))
        rows = rows.join(large, rows.host == F.col("__large"), "left").withColumn("__mine", F.pmod("__draw", F.coalesce("__parts", F.lit(1))).cast("int"))
        joined = rows.join(each, (F.col("host") == F.col("__host")) & (F.col("__mine") == F.col("__part")), "left")
    kept = F.when(F.col("hashes").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("hashes"), F.xxhash64(x))))
    return joined.select(*cols, "host", "lines", kept.alias("kept"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stay of every page."""
    out = drop_boilerplate(table(spark, sf_dir, "pages"))
    return out.select(
        "page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
        F.md5(F.concat_ws("\n", "kept").cast("binary")).alias("kept_md5"),
    )


ORACLE = rf"""
WITH p AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, page_id, lower(regexp_extract(coalesce(url, ''), '{_HOST}', 2)) AS host,
    list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(coalesce(html, ''), '{_HIDDEN}', chr(10), 'g'), '{_TAG}', chr(10), 'g'), '[\r\n]+'),
      lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '') AS lines
  FROM pages),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
l AS (SELECT host, line, count(DISTINCT rid) AS n FROM (SELECT rid, host, unnest(lines) AS line FROM p) GROUP BY host, line),
b AS MATERIALIZED (SELECT host, line FROM l JOIN t USING (host) WHERE n >= {MIN_PAGES} AND n > {RATIO}::DOUBLE * pages),
k AS (
  SELECT u.rid, count(*) AS n_kept, string_agg(u.line, chr(10) ORDER BY u.at) AS kept
  FROM (SELECT rid, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS at FROM p) u
  LEFT JOIN b ON u.host = b.host AND u.line = b.line WHERE b.line IS NULL GROUP BY u.rid)
SELECT p.page_id, p.host, len(p.lines)::BIGINT AS n_lines, (len(p.lines) - coalesce(k.n_kept, 0))::BIGINT AS n_removed, md5(coalesce(k.kept, '')) AS kept_md5
FROM p LEFT JOIN k ON p.rid = k.rid
"""
