"""Extraction contexts, font resolutions, target runs and scale exceptions: one planted defect each."""

import pytest

from scriptorium.operators import validation as V

BOX = [0.0, 0.0, 612.0, 792.0]
EXTRACTION = "doc_id long, schema int, extraction_id string, digest string, expected string, source_sha256 string, title string, outline array<string>, gap double, option_pages array<int>, pages array<int>"
PAGE = "doc_id long, place int, page int, media_box array<double>, crop_box array<double>, effective_box array<double>, rotation int"
FIELD = "doc_id long, place int, page int, name string, type int, rect array<double>"
FONT = "doc_id long, font_id string, class string, bold boolean, italic boolean"
GOOD = {"schema": 1, "extraction_id": "d", "digest": "d", "expected": "d", "source_sha256": "a" * 64, "title": "T", "outline": ["x"], "gap": 3.0, "option_pages": [0, 1], "pages": [0, 1]}


def names(schema):
    return [part.split()[0] for part in schema.split(", ")]


def context(spark, extraction=None, pages=None, fields=None, fonts=None):
    one = {"doc_id": 1, **GOOD, **(extraction or {})}
    return V.context_violations(
        spark.createDataFrame([tuple(one[n] for n in names(EXTRACTION))], EXTRACTION),
        spark.createDataFrame(pages if pages is not None else [(1, i, i, BOX, BOX, BOX, 0) for i in range(2)], PAGE),
        spark.createDataFrame(fields or [], FIELD),
        spark.createDataFrame(fonts or [(1, "f0", "serif", None, True)], FONT),
    )


@pytest.mark.parametrize(
    ("change", "rules"),
    [
        ({}, set()),
        ({"schema": 2}, {"schema"}),
        ({"schema": None}, {"schema"}),
        ({"digest": "e"}, {"identity"}),
        ({"digest": None, "expected": None, "extraction_id": None}, {"identity"}),
        ({"source_sha256": "A" * 64}, {"source-digest"}),
        ({"title": None}, {"title"}),
        ({"outline": ["x", None]}, {"outline"}),
        ({"gap": float("inf")}, {"gap"}),
        ({"pages": [1, 0], "option_pages": [1, 0]}, {"pages"}),
        ({"pages": [0, 0], "option_pages": [0, 0]}, {"pages"}),
        ({"pages": [0, 2], "option_pages": [0, 2]}, {"pages"}),
        ({"pages": [], "option_pages": []}, set()),
        ({"option_pages": [0]}, {"option-pages"}),
    ],
)
def test_extractions(spark, change, rules):
    found = [tuple(r) for r in context(spark, change).collect()]
    assert found == [(1, "extraction", None, r) for r in sorted(rules)]


def test_parts(spark):
    pages = [(1, 0, 0, BOX, BOX, BOX, 90), (1, 1, 2, BOX[:3], None, [0.0, 0.0, 1.0, float("nan")], None)]
    fields = [(1, 0, 1, "a", 7, BOX), (1, 1, 2, None, None, []), (2, 0, 0, "a", 7, BOX)]
    fonts = [(1, "f1", "sans", True, None), (1, "g1", "mono", None, None), (1, "f2", "unknown", None, None)]
    found = {tuple(r)[:4] for r in context(spark, None, pages, fields, fonts).collect()}
    assert found == {
        *((1, "page", "1", r) for r in ("page", "media-box", "crop-box", "effective-box", "rotation")),
        *((1, "field", "1", r) for r in ("page", "name", "type", "rect")),
        (2, "field", "0", "page"), (1, "font", "g1", "font-id"), (1, "font", "g1", "class"),
    }


def test_extraction_without_pages(spark):
    assert {r["rule"] for r in context(spark, pages=[]).collect()} == {"pages"}


def test_resolutions(spark):
    fonts = spark.createDataFrame([(1, "f0", "unknown", None, False), (1, "f1", "serif", True, False), (1, "f2", "unknown", None, None)], FONT)
    rows = [(1, "f0", "sans", True, True, "seen"), (1, "f1", "sans", True, False, "seen"), (1, "f9", "sans", True, True, " "), (1, "f2", "mono", None, True, "a"), (1, "f2", "serif", True, True, "b")]
    resolutions = spark.createDataFrame(rows, FONT + ", reason string")
    found = {tuple(r) for r in V.resolution_violations(fonts, resolutions).collect()}
    assert found == {(1, "f0", "conflict-italic"), (1, "f1", "conflict-class"), (1, "f1", "needless"), (1, "f9", "foreign"), (1, "f9", "reason"), (1, "f2", "duplicate"), (1, "f2", "class"), (1, "f2", "flags")}
    known = {r["font_id"]: tuple(r)[2:] for r in V.resolved_fonts(fonts, resolutions.filter("font_id <> 'f2'")).collect()}
    assert known == {"f0": ("sans", True, False), "f1": ("serif", True, False), "f2": ("unknown", None, None)}


RUNS = [("s1/r0", "Name", "f0"), ("s1/r1", " ", None), ("s1/r2", "bold", "f1"), ("s1/r3", "odd", "f2")]


@pytest.mark.parametrize(
    ("runs", "rules"),
    [
        ([("Nom", ["s1/r0"]), ("gras", ["s1/r2"]), ("x", ["s1/r3"])], {"unresolved-style"}),
        ([("Nom", ["s1/r0"]), ("gras", ["s1/r2"])], {"omitted-run"}),
        ([("Nom", ["s1/r0", "s1/r2"])], {"omitted-run", "mixed-styles"}),
        ([("Nom", ["s1/r0", "s1/r0"])], {"omitted-run", "references"}),
        ([(" ", ["s1/r0"]), ("a‖b", [])], {"omitted-run", "empty-run", "run-text", "references"}),
        ([("Nom", ["s9/r0"])], {"omitted-run", "foreign-run"}),
        ([], {"no-runs", "omitted-run"}),
        (None, {"no-runs", "omitted-run"}),
    ],
)
def test_target_runs(spark, runs, rules):
    targets = spark.createDataFrame([(1, "s1", runs)], "doc_id long, occurrence_id string, runs array<struct<text:string,source_runs:array<string>>>")
    segments = spark.createDataFrame([(1, "s1", "Name boldodd", RUNS)], "doc_id long, occurrence_id string, text string, style_runs array<struct<run_id:string,text:string,font_id:string>>")
    fonts = spark.createDataFrame([(1, "f0", "serif", False, False), (1, "f1", "serif", True, False), (1, "f2", "unknown", None, None)], FONT)
    faces = spark.createDataFrame([(1, "serif", "regular"), (1, "serif", "bold")], "doc_id long, class string, role string")
    assert {r["rule"] for r in V.target_violations(targets, segments, fonts, faces).collect()} == rules
    bare = V.target_violations(targets, segments, fonts, faces.filter("role = 'bold'"))
    used = any("s1/r0" in refs for _, refs in runs or [])
    assert ("missing-face" in {r["rule"] for r in bare.collect()}) == used


def test_coverage_and_scales(spark):
    kind = "array<struct<text:string,source_runs:array<string>>>"
    one = [("Nom", ["s1/r0"])]
    targets = spark.createDataFrame([(1, "s1", one), (1, "s1", one), (1, "s7", one)], f"doc_id long, occurrence_id string, runs {kind}")
    segments = spark.createDataFrame([(1, "s1", "Nämé", [("s1/r0", "Nämé", "f0")]), (1, "s2", "a", [("s2/r0", "a", "f0")])], "doc_id long, occurrence_id string, text string, style_runs array<struct<run_id:string,text:string,font_id:string>>")
    fonts = spark.createDataFrame([(1, "f0", "serif", False, False)], FONT)
    faces = spark.createDataFrame([(1, "serif", "regular")], "doc_id long, class string, role string")
    found = sorted(tuple(r)[1:] for r in V.target_violations(targets, segments, fonts, faces).collect())
    assert found == [("s1", "duplicate"), ("s2", "missing"), ("s7", "unknown")]
    scales = spark.createDataFrame([(1, "s1", "room"), (1, "s1", "room"), (1, "s2", ""), (1, "s9", "room")], "doc_id long, occurrence_id string, reason string")
    assert {tuple(r)[1:] for r in V.scale_violations(scales, segments).collect()} == {("s1", "duplicate"), ("s2", "reason"), ("s9", "unknown")}
