import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.functions import marks
from docloom.functions import text as X
from docloom.operators import compare, matching, pages, scoring, shaping, similarity
from docloom.plans import rubric
from docloom.sources import files, images, store
from docloom.streaming import uploads


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(col(F.col("v")).alias("r")).first().r


def many(spark, col, cases, kind="string"):
    df = spark.createDataFrame([(k, v) for k, (v, _) in enumerate(cases)], f"k int, v {kind}")
    got = {r.k: r.r for r in df.select("k", col(F.col("v")).alias("r")).collect()}
    for k, (v, want) in enumerate(cases):
        assert got[k] == want, (v, got[k], want)


def test_text_functions(spark):
    many(spark, X.strip, [(" a b\x1c\n", "a b"), ("", ""), (None, None)])
    many(spark, X.lines, [("a\n\nb\n", ["a", "", "b"]), ("", []), ("a\r\nb\x85c", ["a", "b", "c"]), (None, None)])
    many(spark, X.normal_header, [(" Req\n ID", "reqid")])
    many(spark, X.normal_id, [("a‑f–0 1\n", "A-F-01"), (None, ""), ("straße", "STRASSE")])
    many(spark, X.without_ids, [(" ATM-F-001 shall abc-nf-12x  LMS-SR-1 x-SEC-0001", "shall abc-nf-12x  LMS-SR-1 x-SEC-0001"), ("AB-sec-12.", ".")])
    many(spark, X.requirement_id, [("•  ABC‑F‑001 — Do it", "ABC-F-001"), ("AB-SO-12 (must) : go", "AB-SO-12"), ("AB-XX-12: no", None), ("A-F-12: no", None), ("AB-F-12 no", None)])
    many(spark, X.requirement_text, [("•  ABC‑F‑001 — Do it ", "Do it"), ("AB-NF-12:", None)])
    many(spark, X.name_tokens, [("Zoë de la Cruz-ANN x", ["ZO", "DE", "LA", "CRUZ", "ANN"]), (None, [])])
    many(spark, X.name_in_filename, [("Spec - JANE DOE PESU-EC 1.pdf", "JANE DOE"), ("a - b PESU c - d PESU.pdf", "d"), ("none.pdf", None), ("x PESU", None)])
    many(spark, lambda c: X.shingles(X.word_tokens(c)), [("A b, c d e F", ["a b c d e", "b c d e f"]), ("One two", ["one two"]), ("éé", []), (None, [])])
    many(spark, lambda c: F.concat_ws("|", *(x.cast("string") for x in X.resubmission(c))), [("Team A (1) (2)", "Team A (1)|2"), ("Team A", "Team A|-1"), ("Team(3)", "Team|3")])
    many(spark, X.stem, [("a.b.pdf", "a.b"), (".docx", ".docx"), ("a", "a")])
    many(spark, X.suffix, [("A.PDF", ".pdf"), ("a", "")])


def test_marks(spark):
    clamp = lambda c: marks.clamp(c, F.lit(6))
    many(spark, clamp, [('"3"', 3), ('"2.5"', 0), ("2.7", 2), ("99", 6), ("-1", 0), ("-0.5", 0), ("null", 0), (None, 0), ("true", 1), ("[1]", 0), ('"x"', 0), ('" 4 "', 4)])
    many(spark, marks.flag_tone, [(None, None), ("", None), ("None", None), ("SCORING ERROR: x", "red"), ("late", "amber")])
    many(spark, marks.score_badge, [(None, "neutral"), (75.0, "green"), (50.0, "amber"), (49.9, "red")], "double")
    many(spark, marks.short_flags, [("x" * 61, "x" * 57 + "..."), ("x" * 60, "x" * 60)])
    kind = lambda c: marks.diagram_kind(c["w"], c["h"], c["b"], c["e"], c["l"])[0]
    cases = [((100, 100, 2, 2, 0), 0), ((130, 100, 1, 0, 30), 1), ((100, 100, 3, 0, 10), 2), ((100, 100, 1, 1, 14), 3), ((100, 100, 2, 0, 0), 4), ((100, 100, 3, 2, 15), 2)]
    many(spark, kind, [(v, marks.DIAGRAM_KINDS[k]) for v, k in cases], "struct<w:int,h:int,b:int,e:int,l:int>")


def test_tables(spark):
    kind = "array<array<string>>"
    t = one(spark, shaping.shape_table, [["Req\nID", "X", "X"], ["1", "a", "b"], [" ", ""], ["2"], ["3", "a", "b", "c"]], kind)
    assert t.headers == ["Req\nID", "X", "X"] and t.req_id_col == "Req\nID" and t.n_data_rows == 3
    assert t.rows == [{"Req\nID": "1", "X": "b"}, {"Req\nID": "2", "X": ""}, {"Req\nID": "3", "X": "b"}]
    assert one(spark, lambda c: shaping.shape_table(c, page=True), [["", "X", None, "X", "X (2)"]], kind).headers == ["Column 1", "X", "Column 3", "X (2)", "X (2)"]
    assert one(spark, shaping.shape_table, [], kind) is None
    many(spark, shaping.text_header, [(["Requirement short", "Require\nment"], "Require\nment"), (["a"], None)], "array<string>")
    raw = [("s", 0, [["ID", "T"], ["1", "a"]]), ("s", 1, [["", "b"], ["2", "c"], [" ", " "]]), ("s", 2, [["ID", "T"], ["9", "z"]]), ("s", 3, [["x"]]), ("s", 4, [["y"]]), ("q", 0, [["k", "T"]])]
    rows = shaping.join_split_tables(spark.createDataFrame(raw, "source string, table_ord int, rows array<array<string>>")).collect()
    assert {(r.source, r.table_ord): r.rows for r in rows} == {("s", 0): [["ID", "T"], ["1", "a"], ["2", "c"]], ("s", 2): [["ID", "T"], ["9", "z"]], ("s", 3): [["x"], ["y"]], ("q", 0): [["k", "T"]]}


def docx(paragraphs, table):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = "".join(map(p, paragraphs)) + "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in table) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", '<r><Relationship Id="1" Type="x/image" Target="media/a.png"/></r>')
        z.writestr("word/media/a.png", b"png")
    return out.getvalue()


def test_folder_to_requirement_rows(spark, tmp_path):
    good = docx(["Intro", " ", "ABC‑F‑001 — The system shall record each login attempt"], [["Req ID", "Requirement"], ["A-1", "The app must keep all its records safe"], ["A-2", "too short"]])
    for name, data in {"Team A (1).docx": good, "bad.docx": b"x", "c.pdf": b"p", "~$l.docx": b"l", "n.txt": b"n"}.items():
        (tmp_path / name).write_bytes(data)
    scan = files.scan(spark, str(tmp_path))
    assert scan.count() == 4 and files.scan(spark, str(tmp_path), skip_locks=True).count() == 3
    decoded = files.ingest(scan).cache()
    assert {r.filename: r.error is None for r in decoded.collect()} == {"Team A (1).docx": True, "bad.docx": False, "c.pdf": False, "~$l.docx": False}
    doc = files.ingested(decoded)
    r = doc.first()
    assert (r.team_id, r.raw_text.split("\n")[0], len(r.tables)) == ("Team A", "Intro", 2) and r.tables[1].rows[0]["Req ID"] == "ABC-F-001"
    rows = shaping.requirement_rows(doc.withColumn("doc_id", F.col("team_id"))).collect()
    assert [(x.table_idx, x.req_id, x.text) for x in rows] == [(0, "A-1", "The app must keep all its records safe"), (1, "ABC-F-001", "The system shall record each login attempt")]
    assert {r.filename: r.error for r in decoded.collect()}["c.pdf"] == "RuntimeError: no PDF decoder given"


def pdf_decoder(range_of=None):
    """Decodes bytes such as b"3" as a file of three pages; b"x..." fails on page 7."""

    def decode(content, first, last):
        if range_of is not None:
            with open(range_of, "a") as out:
                out.write(f"{content.decode()} {first} {last}\n")
        if content.startswith(b"x") and first <= 7 <= last:
            raise ValueError("page 7")
        line = lambda y, t: (0, [t], 0.0, float(y), 50.0, y + 9.0)
        rows = lambda k: [["Req ID", "Requirement"]] * (k == 1) + [[f"A-{k}", f"The part number {k} is kept safe"]]
        return [{"lines": [line(0, f"This is page {k} of a document of many pages"), line(30, "cell")], "tables": [(0.0, 25.0, 60.0, 45.0, rows(k))]} for k in range(first, last + 1)]

    return files.PdfDecoder(lambda content: int(content.decode().lstrip("x")), decode)


def test_pdf_pages_by_ranges(spark, tmp_path):
    log, box = f"{tmp_path}/log", tmp_path / "box"
    box.mkdir()
    good = docx(["Intro"], [["Req ID", "Requirement"], ["A-1", "The app must keep all its records safe"]])
    for name, data in {"A.pdf": b"23", "A (2).pdf": b"3", "B.pdf": b"23", "C.pdf": b"x20", "D.pdf": b"0", "E.pdf": b"zz", "F.docx": good}.items():
        (box / name).write_bytes(data)
    scan = files.scan(spark, str(box)).where("filename LIKE '%.pdf'")
    got, failed = files.decode_pages(scan, pdf_decoder(log), 10)
    assert {r.filename: r.error for r in failed.collect()} == {"C.pdf": "ValueError: page 7", "E.pdf": "ValueError: invalid literal for int() with base 10: 'zz'"}
    seen = {}
    for r in got.collect():
        seen.setdefault(r.source, []).append(r.page)
    assert {k: sorted(v) for k, v in seen.items()} == {"A.pdf": [*range(1, 24)], "A (2).pdf": [1, 2, 3], "B.pdf": [*range(1, 24)], "D.pdf": [0]}
    assert {"23 1 10", "23 11 20", "23 21 23", "3 1 3"} <= set(open(log).read().split("\n"))
    docs, summary = files.batch(spark, str(box), pdf_decoder())
    by = {r.source: r for r in docs.collect()}
    assert set(by) == {"A (2).pdf", "B.pdf", "D.pdf", "F.docx"} and by["D.pdf"].raw_text == ""
    assert by["B.pdf"].raw_text.split("\n") == [f"This is page {k} of a document of many pages" for k in range(1, 24)]
    # the table goes on over all pages, through all ranges
    assert [t.n_data_rows for t in by["B.pdf"].tables] == [23] and [r["Req ID"] for r in by["B.pdf"].tables[0].rows] == [f"A-{k}" for k in range(1, 24)]
    rows = {r.file: (r.lines, r.tables, r.skipped, r.error) for r in summary.collect()}
    assert rows["B.pdf"] == (23, 1, None, None) and rows["A.pdf"] == (None, None, True, None) and rows["C.pdf"][3] == "ValueError: page 7" and rows["F.docx"] == (1, 1, None, None) and rows["D.pdf"] == (0, 0, None, None)


def test_spreadsheet(spark):
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="A" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<r><Relationship Id="r1" Target="worksheets/sheet1.xml"/></r>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{s}"><si><t>Team ID</t></si><si><t>SRS</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="C2"><v>10</v></c></row><row><c r="A3"><v>7</v></c><c r="C3"><v>8.5</v></c></row></sheetData></worksheet>')
    df = spark.createDataFrame([("g.xlsx", out.getvalue())], "filename string, content binary")
    rows = {r.row_idx: r.cells for r in files.sheets(df).collect()}
    assert rows == {1: {"Team ID": None, "SRS": "10.0"}, 2: {"Team ID": "7.0", "SRS": "8.5"}}


def test_teams_and_files(spark):
    sheet = [("s", 1, None, None, "early"), ("s", 2, 1.0, 5.0, "a"), ("s", 3, None, 9.0, "b"), ("s", 4, None, None, " "), ("s", 5, 2.0, None, "c"), ("s", 6, None, None, "d"), ("t", 1, None, None, "x")]
    rows = matching.fill_teams(spark.createDataFrame(sheet, "sheet string, row_idx int, team_id double, mark double, member string"), ["mark"]).orderBy("row_idx").collect()
    assert [(r.member, r.team_id, r.mark) for r in rows] == [("a", 1.0, 5.0), ("b", 1.0, 5.0), ("c", 2.0, None), ("d", 2.0, None)]
    names = ["A.docx", "A.pdf", "B (1).pdf", "B.pdf", "B (1).docx"]
    got = matching.latest_resubmission(spark.createDataFrame(list(enumerate(names)), "input_ord int, filename string"))
    assert {r.filename: r.kept for r in got.collect()} == {"A.docx": False, "A.pdf": True, "B (1).pdf": False, "B.pdf": False, "B (1).docx": True}
    roster = spark.createDataFrame([(0, 0, "Ann", "S1"), (1, 0, "Jane Doe", "S22"), (2, 0, "Jane Doe", None), (3, 0, "Bob", "S3")], "team_ord int, member_ord int, member string, srn string")
    fs = spark.createDataFrame([(1, "x - JANE DOE PESU.pdf", ""), (2, "f.pdf", "by jane doe"), (3, "f.pdf", "s3 and jane doe"), (4, "f.pdf", "ann"), (5, "f.pdf", None)], "file_id int, filename string, raw_text string")
    out = {r.file_id: (r.match_method, r.team_ord, r.confidence) for r in matching.resolve(fs, roster).collect()}
    assert out == {1: ("filename", 1, 1.0), 2: ("content", 1, 0.95), 3: ("content", 3, 1.0), 4: ("none", None, 0.0), 5: ("none", None, 0.0)}
    m = matching.resolve(fs, roster).withColumn("doc_type", F.lit("srs"))
    assert tuple(matching.match_counts(m).first()) == ("srs", 5, 1, 2, 2, 2)
    assert [r.filenames for r in matching.several_files(m).collect()] == [["f.pdf", "x - JANE DOE PESU.pdf"]] and matching.low_confidence(m).count() == 0
    imgs = spark.createDataFrame([(1, 0, b"a"), (1, 1, b"b"), (1, 2, b"a"), (2, 0, b"a"), (2, 1, None)], "doc_id int, ord int, content binary")
    assert sorted((r.doc_id, r.ord, r.repeated_count) for r in matching.distinct_images(imgs).collect()) == [(1, 0, 2), (1, 1, None), (2, 0, None)]
    box, oval, rough, tiny = (900.0, 4, True, 1000.0), (900.0, 8, False, 1000.0), (900.0, 8, False, 2000.0), (1.0, 4, True, None)
    shapes = images.analyse(imgs, lambda b: (300, 200, 0.123456, 40, [box, box, oval, rough, tiny]) if b == b"a" else None).collect()
    assert {(r.type_guess, r.n_boxes, r.n_ellipses, r.edge_density) for r in shapes} == {(marks.DIAGRAM_KINDS[1], 2, 1, 0.1235)} and len(shapes) == 3
    small = images.analyse(imgs, lambda b: (300, 149, 0.1, 40, [])).count()
    assert small == 0


def test_reports(spark):
    docs = [(k, "srs", f"s{k}", "ABC-F-001 and\nXY-NF-0 2", None) for k in range(8)]
    df = spark.createDataFrame(docs, f"doc_id int, doc_type string, source string, raw_text string, tables array<{shaping.TABLE}>")
    raws = [
        'ok {"intro_score": "3", "requirements_score": 2.7, "uml_score": "2.5", "security_score": -1, "functional_requirements_found": ["abc‑f‑001", "ZZ-1", "ZZ-1"], "flags": "None", "overall_feedback": "fine"} end',
        '{"flags": null, "functional_requirements_found": "XY-NF-02"}', "no json", None, '{"intro_score": 1, "intro_score": 2, "flags": "late", "security_objectives_found": ["q"]}', '{"flags": ""}',
        '{"functional_requirements_found": null, "intro_justification": "why"}', "{broken",
    ]
    replies = spark.createDataFrame([(k, r, "timeout" if k == 3 else None) for k, r in enumerate(raws)], "doc_id int, raw string, error string")
    out = {r.doc_id: r for r in scoring.reports(df, replies).collect()}
    assert [c.score for c in out[0].criteria] == [2, 2, 0, 0] and (out[0].total_score, out[0].max_total, out[0].percentage) == (4, 12, 33.3)
    s = out[0].sanity_check
    assert (s.cited_count, s.grounded_count, s.grounded_fraction, s.ungrounded_ids) == (3, 1, 0.333, ["ZZ-1", "ZZ-1"])
    assert out[0].flags.startswith("UNGROUNDED CITATIONS: 2/3 ") and out[0].overall_feedback == "fine"
    assert out[1].flags == "None" and out[1].sanity_check.grounded_count == 1
    assert out[2].flags.startswith("SCORING ERROR") and out[3].flags == "SCORING ERROR: timeout" and out[7].flags.startswith("SCORING ERROR")
    assert out[4].criteria[0].score == 2 and out[4].flags.startswith("late | UNGROUNDED CITATIONS: 1/1")
    assert out[5].flags == "" and out[6].sanity_check.cited_count == 0 and out[6].criteria[0].justification == "why"
    summary = {r.doc_id: r for r in scoring.batch_summary(scoring.reports(df, replies)).collect()}
    assert summary[3].hard_error and summary[0].low_grounding and not any(r.internal_sum_mismatch for r in summary.values())
    chips = compare.id_chips(scoring.reports(df, replies)).where("doc_id = 0").collect()
    assert {(c.item, c.ungrounded) for c in chips} == {("abc‑f‑001", False), ("ZZ-1", True)}


def test_prompts_and_model_calls(spark):
    shape = f"doc_id int, doc_type string, raw_text string, tables array<{shaping.TABLE}>, images array<struct<width:int,height:int,n_boxes:int,n_ellipses:int,n_lines:int,has_diagram_structure:boolean,type_guess:string,page:int,repeated_count:int>>"
    df = spark.createDataFrame([(1, "srs", "body", None, [(5, 6, 1, 2, 3, True, "k", 4, 2)]), (2, "sads", "x", None, None)], shape)
    p = {r.doc_id: r.prompt for r in scoring.prompts(df, {"srs": "PROSE"}).collect()}
    assert p[1].startswith("PROSE") and "body" in p[1] and "- #1 page 4 and 1 more times; k; 1 boxes, 2 ovals, 3 lines; drawn like a diagram" in p[1] and '"uml_score": <integer 0-2>' in p[1]
    assert "No pictures large enough" in p[2] and "api_endpoints_found" in p[2]

    def client(prompt):
        if "body" not in prompt:
            raise ValueError("no")
        return "{}"

    got = {r.doc_id: (r.raw, r.error) for r in scoring.ask(scoring.prompts(df), client, pause_s=0).collect()}
    assert got == {1: ("{}", None), 2: (None, "no")}


def test_rubric(spark):
    assert [r.max_total for r in rubric.rubrics(spark).orderBy("max_total").collect()] == [12, 13, 20]
    assert rubric.criteria(spark).count() == 18 and rubric.categories(spark).count() == 10
    with pytest.raises(ValueError):
        rubric.check_doc_type("x")


def test_stores_and_stream(spark, tmp_path):
    shape = "doc_type string, team_id string, rank long, upload_ord long, source string"
    table, runs = (f"{tmp_path}/{x}" for x in ("table", "runs"))
    a = spark.createDataFrame([("srs", "A", -1, 0, "A.pdf"), ("srs", "A", -1, 1, "A.docx"), ("srs", "B", 2, 2, "B (2).pdf")], shape)
    uploads.merge(spark, table, a)
    b = spark.createDataFrame([("srs", "A", 1, 3, "A (1).pdf"), ("srs", "B", 1, 4, "B (1).pdf")], shape)
    assert {r.team_id: r.skipped for r in store.decisions(uploads.read(spark, table), b).collect()} == {"A": False, "B": True}
    uploads.merge(spark, table, b)
    assert {r.team_id: r.source for r in uploads.read(spark, table).collect()} == {"A": "A (1).pdf", "B": "B (2).pdf"}
    store.put(uploads.read(spark, table), f"{tmp_path}/s", None)
    assert store.archive(spark, f"{tmp_path}/s", runs, "A") == 1 and store.archive(spark, f"{tmp_path}/s", runs) == 2 and store.archive(spark, f"{tmp_path}/s", runs, "Z") is None and store.archive(spark, f"{tmp_path}/none", runs) is None
    assert {(r.run_seq, r.source) for r in spark.read.parquet(runs).collect()} == {(1, "A (1).pdf"), (2, "A (1).pdf"), (2, "B (2).pdf")}
    store.put(a, f"{tmp_path}/p")
    store.put(a.withColumn("doc_type", F.lit("sads")).limit(1), f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 4
    assert "<td>A &lt;b&gt;</td>" in store.render_html(a.limit(1).withColumn("team_id", F.lit("A <b>")), "t")
    store.put_json(a, f"{tmp_path}/j")
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "Team A_ingested.json").write_text('{"source": "A.pdf",\n "raw_text": "x"}')
    (tmp_path / "k" / "deep" / "er").mkdir(parents=True)
    (tmp_path / "k" / "deep" / "er" / "Team B_ingested.json").write_text('{"source": "B.pdf"}')
    (tmp_path / "k" / "deep" / "Team B_score.json").write_text('{"source": "no"}')
    records = lambda deep: {(r.team_id, r.source) for r in files.json_records(spark, f"{tmp_path}/k", "source string, raw_text string", recursive=deep).collect()}
    assert records(False) == {("Team A", "A.pdf")} and records(True) == {("Team A", "A.pdf"), ("Team B", "B.pdf")}


def test_comparison_edges(spark):
    sheets = spark.createDataFrame([(0, "srs", 10.0), (1, "srs", 12.0), (2, "srs", None)], "sheet_ord int, doc_type string, value double")
    assert compare.hand_maximum(sheets).first().hand_max == 12.0
    rows = spark.createDataFrame([("a", 1.0), ("b", None), ("c", -5.0)], "name string, diff_pct double")
    assert [r.name for r in compare.worst_first(rows).collect()] == ["b", "c", "a"]
    team = spark.createDataFrame([("B1", 50.0, "late"), ("a_1", None, None), ("C", 10.0, "None")], "team_id string, percentage double, flags string").withColumn("extracted_ids", F.create_map(F.lit("k"), F.array(F.lit("x"))))
    assert [r.team_id for r in compare.search(team, " _1 ").collect()] == ["a_1"] and compare.search(team, "", "lowscore").count() == 1
    assert [r.team_id for r in compare.sort_rows(team, "score", True).collect()] == ["B1", "C", "a_1"] and compare.sort_rows(team, "idcount:k").count() == 3
    with pytest.raises(ValueError):
        compare.search(team, "", "x")
    ing = spark.createDataFrame([("srs", "A", "A (1).pdf"), ("srs", "B", "B.pdf")], "doc_type string, team_id string, source string")
    sc = spark.createDataFrame([("srs", "A", "A.pdf", 50.0, 6, "None")], "doc_type string, team_id string, source string, percentage double, total_score int, flags string").withColumn("extracted_ids", F.lit(None)).withColumn("sanity_check", F.lit(None))
    assert {r.team_id: (r.percentage, r.score_is_stale) for r in compare.with_scores(ing, sc).collect()} == {"A": (50.0, True), "B": (None, False)}


def test_pages(spark):
    line = lambda y, *spans, kind=0: (kind, list(spans), 0.0, float(y), 50.0, y + 9.0)
    box = lambda y0, y1, rows: (0.0, float(y0), 60.0, float(y1), rows)
    head = [["ID", "Requirement"], ["A-1", "first"]]
    body = "A line that is long enough to count as text"
    rows = [
        ("T (2).pdf", 2, [line(0, "ABC-F-001: The ", " ", "rest")], [line(0, "ABC-F-002: read by machine and longer")], [box(0, 9, [["gone"]])]),
        ("T (2).pdf", 1, [line(0, " ", "Title "), line(10, body), line(20, "cell"), line(30, "cell"), line(40, "x", kind=1), line(50, "  "), line(60, "end")], [line(0, "longer" * 40)], [box(21, 39, head), box(25, 39, [["never"]]), box(200, 210, [["no line"]])]),
        ("u.pdf", 1, [line(0, "short")], [line(0, "tiny")], []), ("v.pdf", 1, [line(0, "short")], None, None), ("w.pdf", 1, [], None, None),
    ]
    df = spark.createDataFrame(rows, f"source string, page int, lines array<{pages.LINE}>, ocr_lines array<{pages.LINE}>, tables array<{pages.BOX}>")
    out = {r.source: r for r in pages.documents(df).collect()}
    assert out["T (2).pdf"].raw_text.split("\n") == ["Title", body, "end", "ABC-F-002: read by machine and longer"]
    assert out["T (2).pdf"].raw_tables == [head] and out["T (2).pdf"].ocr_pages == [2]
    assert out["u.pdf"].raw_text == "short" and out["u.pdf"].ocr_pages is None and out["v.pdf"].raw_text == "short" and out["w.pdf"].raw_text == ""
    doc = {r.source: r for r in pages.ingested(df).collect()}["T (2).pdf"]
    assert doc.team_id == "T" and [t.headers for t in doc.tables] == [["ID", "Requirement"], ["Req ID", "Requirement"]] and doc.tables[1].rows[0]["Req ID"] == "ABC-F-002"


def test_batch_of_a_folder(spark, tmp_path):
    good = docx(["Intro", "ABC‑F‑001 — The system shall record each login attempt"], [["Req ID", "Requirement"], ["A-1", "The app must keep all its records safe"]])
    for name, data in {"A.docx": good, "A (1).docx": good, "B.docx": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    docs, summary = files.batch(spark, str(tmp_path))
    rows = {r.file: (r.team_id, r.lines, r.tables, r.skipped, r.reason) for r in summary.collect()}
    assert rows == {"A.docx": ("A", None, None, True, "superseded by A (1).docx"), "A (1).docx": ("A", 2, 2, None, None), "B.docx": ("B", None, None, None, None)}
    assert summary.where("error IS NOT NULL").first().file == "B.docx" and [r.team_id for r in docs.collect()] == ["A"]
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        files.batch(spark, str(tmp_path / "empty"))
    for name in ("T1_ingested.json", "T1_score.json", "T2_score.json"):
        (tmp_path / name).write_text('{"a": 1}')
    listed = files.list_prefix(spark, str(tmp_path), "T1_")
    assert sorted(r.pathname for r in listed.collect()) == ["T1_ingested.json", "T1_score.json"]
    assert files.read_json(spark, listed.first().path, "a int").first().a == 1


def test_roster_and_relations(spark):
    cells = [
        ("S", 1, {"Team ID": None, "SRS": "10.0", "Team members": "Max"}), ("S", 2, {"Team ID": "1.0", "Team name": "Reds", "Project Title": "p", "SRS": "8.5", "Team members": " Ann ", "SRN": "S1"}),
        ("S", 3, {"Team ID": None, "Team members": "Bob", "SRN": None}), ("S", 4, {"Team ID": "2.0", "Team name": "None", "Team members": None}), ("S", 5, {"Team ID": None, "Team members": "Cy"}),
        ("S", 6, {"Team ID": "3.0", "Team name": "Blues", "SRS": "x", "Team members": "Di", "SRN": "S4"}),
    ]
    df = spark.createDataFrame([(0, *c) for c in cells] + [(1, "R", 2, {"Team ID": "9.0", "Team members": "Ed"})], "sheet_ord int, sheet string, row_idx int, cells map<string,string>")
    members = matching.roster(df)
    got = sorted((r.section, r.team_ord, r.member_ord, r.member, r.team_name, r.project_name, r.srs_mark, r.srn) for r in members.collect())
    assert got == [("R", 1, 0, "Ed", None, None, None, None), ("S", 1, 0, "Ann", "Reds", "p", 8.5, "S1"), ("S", 1, 1, "Bob", "Reds", "p", 8.5, None), ("S", 1, 2, "Cy", "Reds", "p", 8.5, None), ("S", 2, 0, "Di", "Blues", None, None, "S4")]
    teams, people = matching.relations(members)
    assert sorted((r.id, r.section, r.team_name) for r in teams.collect()) == [(1, "S", "Reds"), (2, "S", "Blues"), (3, "R", None)]
    assert sorted((r.team_pk, r.name) for r in people.collect()) == [(1, "Ann"), (1, "Bob"), (1, "Cy"), (2, "Di"), (3, "Ed")]
    assert {(r.doc_type, r.hand_max) for r in compare.hand_maximum(compare.sheet_maxima(df)).collect()} == {("srs", 10.0)}


def test_report_map_and_texts_with_many_names(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "b")], "doc_a string, doc_b string")
    rows = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "doc_id string")
    r = similarity.report(rows, pairs, rows.limit(1)).first()
    assert (r.students_checked, r.common_rows_excluded, r.flagged_row_pair_count, r.flagged_students) == (4, 1, 3, {"a": ["b", "c"], "b": ["a"], "c": ["a"]})
    roster = spark.createDataFrame([(k, j, f"{n}", s) for k, j, n, s in [(2, 0, "Joann Doe", "Q1"), (1, 1, "ann doe", None), (1, 0, "Ann Doe", ""), (3, 0, "Ed", "ZZ"), (4, 0, "Straße", "zz")]], "team_ord int, member_ord int, member string, srn string")
    docs = spark.createDataFrame([(1, "joann doe"), (2, "xann doex"), (3, "q1 ann doe"), (4, "ed"), (5, "Zz"), (6, "STRASSE"), (7, None), (8, "")], "doc_id int, raw_text string")
    got = {r.doc_id: (r.team_ord, r.member, r.confidence) for r in matching.content_matches(docs, roster).collect()}
    assert got == {1: (1, "Ann Doe", 0.95), 2: (1, "Ann Doe", 0.95), 3: (2, "Joann Doe", 1.0), 5: (3, "Ed", 1.0), 6: (4, "Straße", 0.95)}
    assert matching.content_matches(docs, roster.limit(0)).count() == 0


def test_cells_of_a_table_are_taken_once(spark):
    df = spark.createDataFrame([([["A", "A"], ["1", "2"]],)], "cells_in array<array<string>>").select(shaping.shape_table(F.col("cells_in"), page=True).alias("t"))
    assert df._jdf.queryExecution().analyzed().toString().count("cells_in#") <= 3
    t = df.first().t
    assert t.headers == ["A", "A (2)"] and t.rows == [{"A": "1", "A (2)": "2"}]
