import json

import pytest

from docloom.plans import cohort

from .test_documents import docx, pdf_decoder


def client(prompt):
    if "unlucky" in prompt:
        raise ValueError("no answer")
    return "Sure: " + json.dumps({"intro_score": 2, "requirements_score": "3", "functional_requirements_found": ["A-1", "Z-9"], "flags": None, "overall_feedback": "fine"})


def test_folder_to_reports_and_copied_rows(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    table = lambda *rows: [["Req ID", "Requirement"], *([f"A-{k}", t] for k, t in enumerate(rows, 1))]
    shared, common = "The system shall keep all records of each patient safe", "All users must change their passwords every month"
    for name, data in {
        "Reds.docx": docx(["Intro"], table(shared, common, "Only the red team wrote this sentence here")), "Blues (1).docx": docx(["Intro"], table(common, shared.replace("each", "every"))),
        "Blues.docx": docx(["Old"], table("An older version of the same file as above")), "Greens.docx": docx(["unlucky"], table(common, "Nobody else has anything like that row")), "Bad.docx": b"x", "Pages.pdf": b"12",
    }.items():
        (box / name).write_bytes(data)
    got = cohort.assess(spark, str(box), "srs", client, f"{tmp_path}/replies", pdf_decoder(), attempts=1)
    assert sorted(r.team_id for r in got.documents.collect()) == ["Blues", "Greens", "Pages", "Reds"]
    assert {r.file: (bool(r.skipped), r.error is not None) for r in got.files.collect()} == {"Reds.docx": (False, False), "Blues (1).docx": (False, False), "Blues.docx": (True, False), "Greens.docx": (False, False), "Bad.docx": (False, True), "Pages.pdf": (False, False)}
    reports = {r.doc_id: r for r in got.reports.collect()}
    assert set(reports) == {"Reds", "Blues", "Greens", "Pages"} and reports["Greens"].flags == "SCORING ERROR: no answer" and reports["Greens"].total_score == 0
    assert reports["Reds"].sanity_check.grounded_count == 1 and reports["Reds"].sanity_check.ungrounded_ids == ["Z-9"] and reports["Reds"].total_score > 0
    assert {r.doc_id for r in got.summary.collect() if r.hard_error} == {"Greens"}
    pairs = [tuple(r) for r in got.copied.select("doc_a", "req_id_a", "doc_b", "req_id_b").collect()]
    assert pairs == [("Blues", "A-2", "Reds", "A-1")]  # what three teams have is no sign of copying
    assert sorted((r.doc_id, r.owners) for r in got.boilerplate.collect() if r.text == common) == [("Blues", 3), ("Greens", 3), ("Reds", 3)]
    with pytest.raises(ValueError):
        cohort.assess(spark, str(box), "essay", client, f"{tmp_path}/replies")
