from docloom.llm import line_dedup

from .oracle import assert_same


def test_query_equals_sql(spark, sf):
    assert_same(spark, sf, line_dedup.op2, line_dedup.ORACLE)


def test_frequent_lines_of_a_site_go_and_others_stay(spark):
    pages = [(k, f"https://User@Site.org:80/{k}?q", f"<nav>Menu</nav><script>x</script><p>page {k}</p><p>page {k}</p><!-- no -->") for k in range(10)]
    pages += [(20, "http://other.net/", "<p>Menu</p>"), (21, None, None), (22, "no host", ""), (23, "http://other.net", "<p>Menu<br>Menu</p>"), (0, pages[0][1], pages[0][2])]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, kept string")
    rows = line_dedup.drop_boilerplate(df).collect()
    assert len(rows) == len(pages)
    for r in rows:
        if r.host == "site.org":
            assert r.lines[0] == "Menu" and r.kept == [f"page {r.page_id}"] * 2
    # a site of two pages is cleaned too; a line of one page only is no repetition
    assert {r.page_id: r.kept for r in rows if r.host == "other.net"} == {20: [], 23: []}
    alone = line_dedup.drop_boilerplate(df.where("page_id = 20")).first()
    assert alone.kept == ["Menu"]
    assert {r.page_id: (r.host, r.lines) for r in rows if r.page_id in (21, 22)} == {21: ("", []), 22: ("", [])}


def test_joined_without_a_broadcast(spark, sf, monkeypatch):
    monkeypatch.setattr(line_dedup, "MAX_BROADCAST_HASHES", 0)
    assert_same(spark, sf, line_dedup.op2, line_dedup.ORACLE)
    monkeypatch.setattr(line_dedup, "SPLIT_PAGES", 3)  # several parts of a host
    assert_same(spark, sf, line_dedup.op2, line_dedup.ORACLE)


def test_odd_rows(spark):
    """Null and empty html, tags that aren't closed, a very long page, repeated rows and urls, columns with clashing names and maps."""
    long = "<p>first</p>" + "<" * 20_000 + "".join(f"<p>line {k}</p>" for k in range(5_000))
    pages = [(1, "http://a.b/", long), (1, "http://a.b/", long), (2, "http://a.b/", None), (3, "http://a.b/", ""), (None, "http://a.b/", "<p>first<p"), (4, None, "x"), (4, None, "x"), (5, "", "x")]
    df = spark.createDataFrame([(*p, "h", {"k": 1}) for p in pages], "page_id long, url string, html string, host string, lines map<string,int>")
    rows = line_dedup.drop_boilerplate(df).collect()
    assert len(rows) == len(pages)
    by = {}
    for r in rows:
        by.setdefault((r.page_id, r.host), []).append(r)
    assert [len(x.lines) for x in by[1, "a.b"]] == [5_002] * 2 and all(len(x.kept) == 0 for x in by[1, "a.b"])
    assert [(x.lines, x.kept) for x in by[None, "a.b"]] == [(["first<p"], ["first<p"])]
    assert [x.lines for x in by[2, "a.b"] + by[3, "a.b"]] == [[], []] and all(x.kept == [] for x in by[4, ""] + by[5, ""])


def test_no_rows(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert line_dedup.drop_boilerplate(df).count() == 0
