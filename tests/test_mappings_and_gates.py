"""Mappings, extraction invariants and the gate report: one planted defect each."""

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import qa
from scriptorium.sources import documents
from scriptorium.operators import gates, geometry, mapping
from scriptorium.operators import segments as seg

RUN = "array<struct<run_id:string,text:string,offsets:array<int>,origin:array<double>,bbox:array<double>,size:double,color:int,font_id:string>>"
FONTS = "doc_id long, font_id string"
INK = ([0.0, 1.0], [0.0, 0.0, 1.0, 1.0], 9.0, 0)
SCHEMA = f"doc_id long, id int, occurrence_id string, page int, text string, bbox array<double>, origin array<double>, dir array<double>, size double, color int, style_runs {RUN}"
GOOD = {"doc_id": 1, "id": 4, "occurrence_id": "s4", "page": 0, "text": "Hello", "bbox": [0.0, 0.0, 1.0, 1.0], "origin": [0.0, 1.0], "dir": [1.0, 0.0], "size": 10.0, "color": 0, "style_runs": [("s4/r0", "He", [0, 2], *INK, "f1"), ("s4/r1", "llo", [2, 5], *INK, "f1")]}


@pytest.mark.parametrize(
    ("change", "rule"),
    [
        ({}, None),
        ({"occurrence_id": "s5"}, "identity"),
        ({"page": 3}, "page"),
        ({"bbox": [0.0, 1.0]}, "box"),
        ({"origin": [0.0, float("nan")]}, "origin"),
        ({"dir": None}, "direction"),
        ({"size": 0.0}, "size"),
        ({"color": -1}, "colour"),
        ({"style_runs": []}, "no-runs"),
        ({"style_runs": [("s4/r0", "He", [0, 2], *INK, "f1"), ("s4/r0", "llo", [2, 5], *INK, "f1")]}, "run-names"),
        ({"style_runs": [("s4/r0", "He", [0, 2], *INK, "f1"), ("s4/r1", "lo", [2, 4], *INK, "f1")]}, "run-tiling"),
        ({"style_runs": [("s4/r0", "Hello", [0, 5, 5], *INK, None)]}, "run-tiling"),
        ({"style_runs": [("s4/r0", "Hello", [0, 5], *INK, None)]}, None),
        ({"style_runs": [("s4/rx", "Hello", [0, 5], *INK, None)]}, "run-names"),
        ({"style_runs": [("s4/r0", "Hello", [0, 5], [0.0], *INK[1:], None)]}, "run-geometry"),
        ({"style_runs": [("s4/r0", "Hello", [0, 5], *INK[:2], None, 0, None)]}, "run-geometry"),
        ({"style_runs": [("s4/r0", "Hello", [0, 5], *INK, "f2")]}, "run-font"),
        ({"size": float("inf")}, "size"),
        ({"id": -1, "occurrence_id": "s-1"}, "identity"),
    ],
)
def test_extraction_invariants(spark, change, rule):
    row = {**GOOD, **change}
    df = spark.createDataFrame([tuple(row[c.split()[0]] for c in SCHEMA.replace(RUN, "x").split(", "))], SCHEMA)
    pages = spark.createDataFrame([(1, 0)], "doc_id long, page int")
    found = {r["rule"] for r in mapping.extraction_violations(df, pages, spark.createDataFrame([(1, "f1")], FONTS)).collect()}
    assert (rule in found) if rule else not found


def test_duplicate_occurrences(spark):
    names = [c.split()[0] for c in SCHEMA.replace(RUN, "x").split(", ")]
    df = spark.createDataFrame([tuple(GOOD[n] for n in names)] * 2, SCHEMA)
    assert {r["rule"] for r in mapping.extraction_violations(df, spark.createDataFrame([(1, 0)], "doc_id long, page int"), spark.createDataFrame([(1, "f1")], FONTS)).collect()} == {"duplicate"}


def test_body_offset(spark):
    s = spark.createDataFrame([(1, 0, 0, "a.", "  ", "Rent", 10.0, 20.0, 1.0, 0.0), (1, 0, 1, "b.", " ", "Other", 10.0, 40.0, 1.0, 0.0)], "doc_id long, page int, id int, marker string, gap string, core string, ox double, oy double, dx double, dy double")
    drawn = [(1, 0, 0, i, c, 10.0 + 3 * i, 20.0) for i, c in enumerate("a.  Rent")] + [(1, 0, 1, i, c, 10.0 + 3 * i, 40.0) for i, c in enumerate("b. Rest")]
    chars = spark.createDataFrame(drawn, "doc_id long, page int, line int, char_no int, c string, x double, y double")
    assert {r["id"]: r["body_dx"] for r in mapping.with_body_offset(s, chars).collect()} == {0: 12.0, 1: None}


def test_merges(spark):
    s = spark.createDataFrame([(1, 0, i, t) for i, t in enumerate(["A", "B", "A", "C"])], "doc_id long, page int, id int, text string")
    m = spark.createDataFrame([(1, 0, 0, ["A", "C "]), (1, 1, 0, ["C", "A"]), (1, 2, 5, ["A"])], "doc_id long, merge_no int, page int, lines array<string>")
    rows = {r["merge_no"]: (r["ids"], r["matched"]) for r in mapping.merge_matches(s, m).collect()}
    assert rows == {0: ([0, 3], True), 1: ([3], False), 2: ([], False)}


def test_metadata_is_retargeted(spark):
    docs = spark.createDataFrame([(1, "Form", ["One", "Two"]), (2, "Other", [])], "doc_id long, title string, outline array<string>")
    named = spark.createDataFrame([("Form", "Formular"), ("Two", "Zwei"), ("One", "")], "core string, target string")
    rows = {r["doc_id"]: (r["title"], r["outline"], r["lang"]) for r in mapping.retargeted_metadata(docs, named, "de").collect()}
    assert rows == {1: ("Formular", ["One", "Zwei"], "de"), 2: ("Other", [], "de")}


def test_glyphs_and_repertoires(spark):
    targets = spark.createDataFrame([("f", "aé‍"), ("f", "ab")], "font string, text string")
    known = spark.createDataFrame([("f", "a"), ("f", "b")], "font string, char string")
    assert [tuple(r) for r in mapping.missing_glyphs(targets, known).collect()] == [("f", "é", 1)]
    plain = spark.createDataFrame([("s1", "ok"), ("s2", "a​b")], "occurrence_id string, text string")
    assert [r["occurrence_id"] for r in mapping.plain_violations(plain).collect()] == ["s2"]


def test_ratios(spark):
    ink = spark.createDataFrame([(1, 0.0, -8.0, 100.0, 2.0, 100.0), (2, -4.0, -8.0, 10.0, 0.0, 10.0), (3, 0.0, -8.0, 100.0, 2.0, 100.0)], "run_id int, x0 double, y0 double, x1 double, y1 double, advance double")
    rooms = spark.createDataFrame([(1, 50.0, 50.0, 80.0, 50.0, False), (2, 1.0, 50.0, 50.0, 50.0, False), (3, 9.0, 9.0, -5.0, 9.0, False), (4, 1.0, 1.0, 1.0, 1.0, False)], "run_id int, left double, top double, right double, bottom double, allowed boolean")
    assert {r["run_id"]: (r["ratio"], r["status"]) for r in geometry.glyph_ratios(ink, rooms).collect() if r["run_id"] != 4} == {1: (0.8, "fits"), 2: (0.25, "below-floor"), 3: (-0.05, "unsafe")}
    row = spark.range(1).select(geometry.leader_dots(F.lit(50.0), F.lit(100.0), F.lit(30), F.lit(3.0)), geometry.leader_dots(F.lit(50.0), F.lit(100.0), F.lit(5), F.lit(3.0)), geometry.leader_dots(F.lit(120.0), F.lit(100.0), F.lit(5), F.lit(3.0))).first()
    assert tuple(row) == (16, 5, 0)


def test_source_runs_and_obstacles(spark):
    spans = spark.createDataFrame([(1, 0, 0, "Hel", ["f1"]), (1, 0, 1, "lo", ["f1", "f2"]), (1, 0, 2, "!", [])], "doc_id long, id int, span_no int, text string, candidates array<string>")
    rows = seg.source_runs(spans).orderBy("span_no").collect()
    assert [(r["start"], r["end"], r["font_id"], r["unresolved"]) for r in rows] == [(0, 3, "f1", None), (3, 5, None, "ambiguous-font"), (5, 6, None, "missing-font")]
    box = "doc_id long, page int, x0 double, y0 double, x1 double, y1 double"
    widgets, strokes, rects = (spark.createDataFrame(r, box) for r in ([(1, 0, 5.0, 1.0, 9.0, 2.0)], [(1, 0, 7.0, 9.0, 7.5, 1.0), (1, 0, 7.0, 1.0, 70.0, 1.0)], [(1, 0, 1.0, 1.0, 2.0, 9.0), (1, 0, 1.0, 1.0, 2.0, 3.0)]))
    assert sorted(r["x"] for r in seg.page_obstacles(widgets, strokes, rects).collect()) == [1.0, 2.0, 5.0, 7.0]


def test_report_of_all_gates(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    field = "doc_id long, name string, type string"
    page = "doc_id long, page int, media_box array<double>, crop_box array<double>, rotation int"
    box = [0.0, 0.0, 612.0, 792.0]
    button = "doc_id long, name string, caption string, flags int, annotation_flags int"
    strings = "doc_id long, lang string, title string, outline array<string>, struct_tree boolean"
    widget = "doc_id long, field string, slot string, export string, text string"
    status = "doc_id long, status string"
    make = spark.createDataFrame
    inputs = {
        "documents": docs,
        "fields": make([(1, "a", "T"), (2, "a", "T")], field), "fields_out": make([(1, "a", "T")], field),
        "options": make([(1, "c", ["x", "y"])], "doc_id long, name string, exports array<string>"), "options_out": make([(1, "c", ["y", "x"])], "doc_id long, name string, exports array<string>"),
        "widgets": make([(1, "a", "tooltip", None, "Name")], widget), "widgets_out": make([(1, "a", "tooltip", None, "Name")], widget),
        "trials": make([(1, 0, None, None), (2, 3, True, False)], "doc_id long, n_fields int, text_kept boolean, box_kept boolean"),
        "pages": make([(1, 0, box, box, 0), (2, 0, box, box, 0)], page), "pages_out": make([(1, 0, box, box, 90), (2, 0, box, box, 0)], page),
        "blank_pages": make([(1, 0, " ", 80), (2, 0, "x", 80)], "doc_id long, page int, text string, ink int"),
        "ink_pages": make([(1, 0, 100, 10), (2, 0, 100, 100)], "doc_id long, page int, ink_a int, ink_b int"),
        "visible_pages": make([(1, 0, 100.0, 1), (2, 0, 100.0, 50)], "doc_id long, page int, area double, changed int"),
        "text": make([(1, "one two x “Paid now” Print"), (2, "one two “Paid now”")], "doc_id long, text string"),
        "authored": make([(2, "x")], "doc_id long, text string"),
        "page_text": make([(1, 0, "ﺏﺕﺙ"), (2, 0, "abc")], "doc_id long, page int, text string"),
        "shaping": make([(1, "PASS"), (1, "FAIL")], status), "faces": make([(2, "REVIEW")], status), "tells": make([(1, "REVIEW"), (1, "FAIL")], status), "typography": make([(1, "PASS")], status),
        "lines": make([(1, 0, 0, "「これ", 0.0, 0.0, 50.0, 10.0), (1, 0, 1, "。悪い", 0.0, 14.0, 50.0, 24.0)], "doc_id long, page int, line_no int, text string, x0 double, y0 double, x1 double, y1 double"),
        "runs": make([(1, "a b c", "running"), (2, "a", "isolated")], "doc_id long, run string, bucket string"),
        "mapping": make([("Form", "Formular")], "core string, target string"),
        "targets": make([(1, "one two"), (2, "three")], "doc_id long, target string"), "actual_text": make([(1, "x")], "doc_id long, text string"),
        "captions": make([(1, "p", "Print", 1 << 16, 0)], button), "captions_out": make([(1, "p", "Print", 1 << 16, 0)], button),
        "wide_captions": make([(2,)], "doc_id long"),
        "overrides": make([(1, 0, 0, "gone")], "doc_id long, page int, override_no int, contains string"), "segments": make([(1, 0, 1, "here")], "doc_id long, page int, id int, text string"),
        "strings": make([(1, "en", "Form", [], False)], strings), "strings_out": make([(1, "en", "Form", [], False)], strings),
        "scale": make([(1, [1]), (2, None)], "doc_id long, runs array<int>"),
        "spans": make([(1, "quoted", "Paid now"), (2, "quoted", "Gone now")], "doc_id long, kind string, snippet string"),
    }
    found = {(r["gate"], r["doc_id"]): r["status"] for r in gates.report(inputs).collect()}
    wanted = {
        "field-parity": ("PASS", "FAIL"), "opt-export-parity": ("FAIL", None), "widget-text": ("REVIEW", None), "fill-roundtrip": ("SKIP", "FAIL"), "page-parity": ("FAIL", "PASS"),
        "extractable-text": ("FAIL", None), "ink-ratio": ("FAIL", "PASS"), "visible-text": ("FAIL", "PASS"), "canonical-text": ("FAIL", "PASS"), "arabic-letterforms": ("FAIL", None),
        "conjunct-shaping": ("FAIL", None), "kinsoku": ("REVIEW", None), "han-forms": (None, "REVIEW"), "leak-cjk": ("FAIL", None), "leak-running": ("FAIL", "PASS"), "leak-isolated": ("PASS", "REVIEW"),
        "empty-targets": ("PASS", "PASS"), "placement": ("PASS", "FAIL"), "shaped-actualtext": ("PASS", "PASS"), "button-captions": ("FAIL", "PASS"), "caption-width": ("PASS", "FAIL"),
        "override-markers": ("FAIL", "SKIP"), "metadata": ("FAIL", "PASS"), "metadata-lang": ("REVIEW", "REVIEW"), "scaled-runs": ("REVIEW", "SKIP"), "identifiers": ("PASS", "FAIL"), "typography": ("PASS", None),
    }
    assert found == {(g, d): s for g, both in wanted.items() for d, s in zip((1, 2), both) if s}
    assert gates.report({"documents": docs}).collect() == []


def test_gates_judge_their_own_rows(spark):
    """leak-scan, conjunct-shaping, han-forms and leak-cjk from scripts, probes and lines; empty targets by document."""
    make = spark.createDataFrame
    inputs = {
        "documents": make([(1,), (2,), (3,)], "doc_id long"),
        "scans": make([(1, "CJK", "CJK", True), (2, "CJK", "CJK", None), (3, "Latin", "Latin", False)], "doc_id long, source_script string, output_script string, by_tell boolean"),
        "shaping": make([(1, 4, 4, 3, "Noto Sans", "NotoSans", "noto-sans"), (2, 4, 4, 4, "A", "A", "A"), (3, 4, 4, 3, "A", "B", "A")], "doc_id long, codepoints int, naive int, shaped int, naive_font string, shaped_font string, expected_font string"),
        "faces": make([(1, "f", "直", 0.0, 0.3), (1, "f", "骨", 0.01, 0.2), (2, "f", "直", 0.3, 0.0), (2, "f", "骨", 0.2, 0.01), (3, "f", "直", 0.0, 0.3)], "doc_id long, face string, character string, own double, other double"),
        "cjk_lines": make([(1, 0, "漢字だけ"), (2, 0, "plain")], "doc_id long, line_no int, text string"),
        "mapping": make([(1, "a", " \u00a0"), (2, "a", "x"), (2, "b", None)], "doc_id long, core string, target string"),
    }
    found = {(r["gate"], r["doc_id"]): (r["status"], r["n_findings"]) for r in gates.report(inputs, conventions=("JP", "SC")).collect()}
    assert {k: v[0] for k, v in found.items() if k[0] == "leak-scan"} == {("leak-scan", 1): "SKIP", ("leak-scan", 2): "REVIEW"}
    assert [found["conjunct-shaping", d][0] for d in (1, 2, 3)] == ["PASS", "FAIL", "FAIL"]
    assert [found["han-forms", d][0] for d in (1, 2, 3)] == ["PASS", "FAIL", "REVIEW"]
    assert found["leak-cjk", 1][0] in ("FAIL", "REVIEW") and ("leak-cjk", 2) not in found
    assert [found["empty-targets", d] for d in (1, 2, 3)] == [("FAIL", 1), ("PASS", 0), ("PASS", 0)]


def test_qa_driver(spark):
    make = spark.createDataFrame
    entries = make([("Pay 5 now", "Zahle 6 jetzt"), ("pay 5 now!", "Zahle 5 jetzt!"), ("skipped 1", "2"), ("null one", None), ("the form", "das Blatt")], "core string, target string")
    out = qa.qa_check(entries, make([("skipped 1",)], "core string"), None, make([("form", "Formular")], "source string, target string")).collect()
    assert [(r["core"], r["kind"], r["severity"]) for r in out] == [("the form", "glossary", "error"), ("Pay 5 now", "numbers", "error"), ("Pay 5 now", "consistency", "warn")]


def test_termbase_and_review_state_can_be_written_again(spark, tmp_path):
    merged = spark.createDataFrame([(1, "a", "b", "added"), (2, "c", "d", "conflict"), (3, "e", "f", "added")], "ord int, source string, target string, action string")
    for _ in range(2):
        documents.append_termbase(merged, f"{tmp_path}/terms")
    documents.append_termbase(spark.createDataFrame([(4, "g", "h", "added")], merged.schema), f"{tmp_path}/terms")
    assert sorted(map(tuple, spark.read.option("header", True).csv(f"{tmp_path}/terms").collect())) == [("a", "b"), ("e", "f"), ("g", "h")]
    verdicts = spark.createDataFrame([(1, True, "open"), (2, False, "no-reviser")], "doc_id long, present boolean, review_line string")
    for at in ("t1", "t2"):
        documents.write_review_state(verdicts, f"{tmp_path}/state", at)
    assert {(r["doc_id"], r["run_at"]) for r in spark.read.json(f"{tmp_path}/state").collect()} == {(1, "t2"), (2, "t2")}


def test_scaled_runs_and_captures(spark):
    runs = spark.createDataFrame([(1, 1, "b", 0.9), (1, None, "a", 0.8), (1, 0, "c", 0.5)], "doc_id long, page int, key string, ratio double")
    assert [r["key"] for r in geometry.scaled_in_order(runs, 2).collect()] == ["a", "c"]
    s = spark.createDataFrame([(1, 0, 5, "c", 1.0, 2.0, 3.0, 4.0), (1, 0, 4, "c", 0.0, 2.0, 3.0, 4.0)], "doc_id long, page int, id int, core string, x0 double, y0 double, x1 double, y1 double")
    boxes = spark.createDataFrame([(1, 1, "b")], "doc_id long, page int, key string")
    found = {r["key"]: (r["segment"] and r["segment"]["id"], r["boxed"]) for r in geometry.located(runs, s, boxes).collect()}
    assert found == {"a": (None, False), "b": (None, True), "c": (4, False)}
    refusals = spark.createDataFrame([(1, "overflow", None, None), (1, "typography", "below-scale-floor", 0.6), (1, "typography", "other", 0.9), (1, "scaled", "", 0.72)], "doc_id long, kind string, reason string, ratio double")
    assert geometry.captured(refusals, None).count() == 2 and geometry.captured(refusals, 0.75).count() == 3
    turned = spark.createDataFrame([(1, 0, 0, 1.0, 0.0), (1, 0, 1, 0.0, 1.0)], "doc_id long, page int, id int, dx double, dy double")
    assert [r["id"] for r in geometry.drawing_order(turned).orderBy("place").collect()] == [1, 0]
