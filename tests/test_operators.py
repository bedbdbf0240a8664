"""Operators on small hand-made inputs, planted defects, and plain Python versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import constants as K
from scriptorium.operators import content, fonts, geometry, layout, leaks, parity, qa, raster, review
from scriptorium.operators import segments as seg

SEGMENT = "doc_id long, page int, id int, x0 double, y0 double, x1 double, y1 double, ox double, oy double, size double, text string, core string, passthrough boolean"


def segments(spark, rows):
    return spark.createDataFrame([(1, 0, i, x0, y, x1, y + 10, x0, y, 10.0, t, t, False) for i, x0, x1, y, t in rows], SEGMENT)


def test_clean_pairs_have_no_findings(spark):
    pairs = spark.createDataFrame([("Pay by 12/31/2024.", "Zahlen bis 12/31/2024."), ("Total (net):", "Summe (netto):"), ("x", None)], "core string, target string")
    assert qa.pair_findings(pairs, F.lit(False)).collect() == []


@pytest.mark.parametrize(
    ("core", "target", "kind", "severity"),
    [
        ("Due 12/31/2024.", "Bis 12/30/2024.", "dates", "error"),
        ("Due 12/31/2024.", "Bis 31.12.2024.", "dates", "warn"),
        ("Pay $1,250.00 now", "Zahle 1.251,00 nun", "numbers", "error"),
        ("State of mind", "State of mind", "untranslated", "warn"),
        ("A (b) of it", "A (b von es", "brackets", "error"),
        ("Name of it:", "Name von es", "punctuation", "warn"),
        ("Name of it", "Name  von es", "spacing", "warn"),
        ("Name of it ok", "Name von es , ok", "spacing", "warn"),
        ("Name of all of it", "Na", "length", "warn"),
        ("Name", "Nameeeeeeeeeeeee", "length", "warn"),
    ],
)
def test_each_defect_is_found(spark, core, target, kind, severity):
    pairs = spark.createDataFrame([(core, target)], "core string, target string")
    found = [(r["kind"], r["severity"]) for r in qa.pair_findings(pairs, F.lit(False)).collect()]
    assert (kind, severity) in found


def test_short_targets_without_spaces_are_fine(spark):
    pairs = spark.createDataFrame([("Name of the person", "姓名")], "core string, target string")
    assert "length" not in [r["kind"] for r in qa.pair_findings(pairs, F.lit(True)).collect()]
    assert "length" in [r["kind"] for r in qa.pair_findings(pairs, F.lit(False)).collect()]
    assert qa.target_script(pairs).first()["script"] == "CJK"


def test_consistency_and_glossary(spark):
    pairs = spark.createDataFrame([("State:", "Staat"), ("state", "Land"), ("Rent", "Miete"), ("rent!", "miete")], "core string, target string")
    rows = qa.inconsistent(pairs).collect()
    assert [(r["key"], r["n_members"], r["n_targets"]) for r in rows] == [("state", 2, 2)]
    terms = spark.createDataFrame([("rent", "Mietzins"), ("state", "Staat")], "source string, target string")
    found = {(r["core"], r["term"]) for r in qa.glossary_findings(pairs, terms).collect()}
    assert found == {("Rent", "rent"), ("rent!", "rent"), ("state", "state")}


def test_glossary_both_ways_agree(spark, monkeypatch):
    pairs = spark.createDataFrame([("the landlord rents", "x"), ("Rent due", "Miete"), ("none", "y"), ("currents", "z")], "core string, target string")
    terms = spark.createDataFrame([("rent", "Miete"), ("landlord", "Vermieter"), ("no", "kein")], "source string, target string")
    small = {tuple(r) for r in qa.glossary_findings(pairs, terms).collect()}
    monkeypatch.setattr(qa, "BROADCAST_TERMS", 1)
    assert {tuple(r) for r in qa.glossary_findings(pairs, terms).collect()} == small


def test_verdict_and_order(spark):
    findings = spark.createDataFrame([("b", "warn", "x"), ("a", "error", "y")], "kind string, severity string, core string")
    row = qa.verdict(findings).first()
    assert (row["n_errors"], row["n_warnings"], row["ok"], row["exit_code"]) == (1, 1, False, 1)
    assert [r["kind"] for r in qa.ordered(findings).collect()] == ["a", "b"]


def test_merge_candidates(spark):
    s = segments(spark, [(0, 72.0, 300.0, 100.0, "This sentence is"), (1, 73.0, 300.0, 114.0, "wrapped over two lines."), (2, 72.0, 300.0, 128.0, "Alone."), (3, 200.0, 300.0, 142.0, "elsewhere")])
    assert [(r["ids"], r["lines"]) for r in seg.merge_candidates(s).collect()] == [([0, 1], ["This sentence is", "wrapped over two lines."])]


def test_narrow_columns_against_plain_python(spark):
    r = random.Random(5)
    rows = [(i, 72.0 + r.choice([0, 1, 3, 5, 40]), 0.0, float(r.randrange(0, 300, 7)), "w") for i in range(60)]
    rows = [(i, x, x + r.choice([20.0, 95.0]), y, t) for i, x, _, y, t in rows]
    wanted, run = [], []
    for i, x0, x1, y, _ in sorted((q for q in rows if q[2] - q[1] < K.NARROW_WIDTH), key=lambda q: (q[1], q[3], q[0])):
        if run and abs(x0 - run[0][1]) < 4 and 0.5 < y - run[-1][3] < 22:
            run.append((i, x0, x1, y))
            continue
        if len(run) >= 3:
            wanted.append([q[0] for q in run])
        run = [(i, x0, x1, y)]
    if len(run) >= 3:
        wanted.append([q[0] for q in run])
    assert sorted(x["ids"] for x in seg.narrow_columns(segments(spark, rows)).collect()) == sorted(wanted)
    assert wanted


def test_leaks(spark):
    text = "Das ist ein Text. The rent is due now, and Schedule bleibt. La suma"
    texts = spark.createDataFrame([(1, text)], "doc_id long, text string")
    source = leaks.source_words(spark.createDataFrame([(1, "Schedule rent plan: when rent schedule plan shifts")], "doc_id long, text string"))
    out = spark.createDataFrame([(1, "Rent schedule plan bleibt; Schedule allein")], "doc_id long, text string")
    runs = leaks.source_word_runs(out, source)
    assert {(r["run"], r["bucket"]) for r in runs.collect()} == {("Rent schedule plan", "running"), ("Schedule", "isolated")}
    keep = spark.createDataFrame([(1, "RENT, schedule plan!")], "doc_id long, phrase string")
    assert {r["run"] for r in leaks.without_kept(runs, keep).collect()} == {"Schedule"}
    allow = spark.createDataFrame([("schedule",)], "word string")
    words = leaks.source_words(spark.createDataFrame([(1, "Schedule rent")], "doc_id long, text string"), allow)
    assert {r["word"] for r in words.collect()} == {"rent"}
    latin = {(r["run"], r["bucket"]) for r in leaks.script_runs(texts, allow=["text"]).collect()}
    assert ("The rent is due now", "running") in latin and ("La suma", "running") not in latin
    thai = spark.createDataFrame([(1, "abc สวัสดีครับ และ ไทย")], "doc_id long, text string")
    assert {(r["run"][:3], r["bucket"]) for r in leaks.script_runs(thai, "Thai").collect()} >= {("ไทย", "isolated")}


def test_long_texts_do_not_overflow(spark):
    texts = spark.createDataFrame([(1, "word " * 60_000)], "doc_id long, text string")
    assert leaks.script_runs(texts).agg(F.sum("n_words")).first()[0] == 60_000


def test_tell_lines(spark):
    lines = spark.createDataFrame([(1, 0, "これはひらがなです"), (1, 1, "汉字"), (1, 2, "plain")], "doc_id long, line_no int, text string")
    assert [(r["line_no"], r["status"]) for r in leaks.tell_lines(lines, "JP", "SC").orderBy("line_no").collect()] == [(0, "FAIL")]


def test_missing_targets(spark):
    page = spark.createDataFrame([(1, "One two\nthree 日本\n語 x y")], "doc_id long, text string")
    targets = spark.createDataFrame([(1, "two three"), (1, "日本語"), (1, "threex"), (1, "x y"), (1, "Z"), (1, "no where")], "doc_id long, target string")
    assert {r["target"] for r in parity.missing_targets(page, targets).collect()} == {"threex", "no where"}


def test_full_names_and_cycles(spark):
    fields = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, 5, "d"), (5, 4, "e")], "id long, parent long, part string")
    names = {r["id"]: r["full_name"] for r in parity.full_names(fields).collect()}
    assert names[3] == "a.b.c" and names[2] == "a.b" and names[4] == "e.d"


def test_resolved_keys(spark):
    names = spark.createDataFrame([(1, "a.x"), (1, "b.x"), (1, "a.y")], "doc_id long, name string")
    keys = spark.createDataFrame([(1, "x"), (1, "y"), (1, "a.y"), (1, "b.x"), (1, "q")], "doc_id long, key string")
    found = {r["key"]: (r["name"], r["problem"]) for r in parity.resolved_keys(keys, names).collect()}
    assert found["x"] == (None, "ambiguous") and found["q"] == (None, "unknown")
    assert found["b.x"] == ("b.x", None) and found["y"][1] == found["a.y"][1] == "two-keys"


def test_captions(spark):
    button = 1 << 16
    original = spark.createDataFrame([(1, n, c, button, 0) for n, c in (("p", "Print"), ("q", "Save it"), ("r", "Reset"), ("s", "Help me"))], "doc_id long, name string, caption string, flags int, annotation_flags int")
    output = spark.createDataFrame([(1, "p", "Print", button, 0), (1, "q", "Sichern", button, 0), (1, "r", "Reset", button, 2), (1, "s", "Hilfe", button, 0)], "doc_id long, name string, caption string, flags int, annotation_flags int")
    text = spark.createDataFrame([(1, "Help me stays")], "doc_id long, text string")
    assert {r["name"] for r in parity.leftover_captions(original, output, text).collect()} == {"p", "s"}
    wide = spark.createDataFrame([(1, "p", "wwww", 0.0, 20.0, 0.0, 14.0, 0.0), (1, "q", "w", 0.0, 20.0, 0.0, 14.0, 0.0)], "doc_id long, name string, caption string, x0 double, x1 double, y0 double, y1 double, font_size double")
    advances = spark.createDataFrame([("w", 0.7)], "char string, advance double")
    assert [r["name"] for r in parity.caption_overflows(wide, advances).collect()] == ["p"]


def test_overrides_and_metadata(spark):
    s = spark.createDataFrame([(1, 0, 1, "Total due now")], "doc_id long, page int, id int, text string")
    o = spark.createDataFrame([(1, 0, 0, "due"), (1, 0, 1, "Total"), (1, 0, 2, "gone")], "doc_id long, page int, override_no int, contains string")
    assert [tuple(r) for r in parity.override_matches(s, o).collect()] == [(1, 1, 0)]
    assert [r["override_no"] for r in parity.override_misses(s, o).collect()] == [2]
    schema = "doc_id long, lang string, title string, outline array<string>, struct_tree boolean"
    original = spark.createDataFrame([(1, "en", "Form", ["One"], True)], schema)
    output = spark.createDataFrame([(1, "en", "Form", ["One", "Zwei"], True)], schema)
    mapping = spark.createDataFrame([("Form", "Formular"), ("One", "Eins")], "core string, target string")
    assert {r["what"] for r in parity.metadata_misses(original, output, mapping, "de").collect()} == {"lang", "title", "outline", "struct-tree"}


def test_empty_targets(spark):
    mapping = spark.createDataFrame([("a", " "), ("b", " "), ("c", None), ("d", "x"), ("e", "<b></b>")], "core string, target string")
    assert {r["core"] for r in parity.empty_targets(mapping).collect()} == {"a", "b", "e"}


def test_silent_gate_says_nothing(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    bad = spark.createDataFrame([(1,)], "doc_id long")
    assert {(r["doc_id"], r["status"]) for r in parity.gate("placement", bad, docs).collect()} == {(1, "FAIL"), (2, "PASS")}
    assert [r["doc_id"] for r in parity.gate("arabic-letterforms", bad, docs, none=None).collect()] == [1]


def plain_stacks(lines):
    out = []
    for line in sorted(lines, key=lambda t: (t[2], t[1], t[0])):
        for stack in out:
            p = stack[-1]
            h = line[4] - line[2]
            if min(line[3], p[3]) - max(line[1], p[1]) >= 0.5 * min(line[3] - line[1], p[3] - p[1]) and -0.5 * h <= line[2] - p[4] <= 1.5 * h:
                stack.append(line)
                break
        else:
            out.append([line])
    return {tuple(x[0] for x in s) for s in out}


def test_stacks_against_plain_python(spark):
    r = random.Random(9)
    lines = [(i, float(x), float(y), float(x + r.randrange(20, 120)), float(y + 10)) for i, (x, y) in enumerate((r.randrange(0, 300, 30), r.randrange(0, 200, 11)) for _ in range(50))]
    df = spark.createDataFrame([(1, 0, i, "t", x0, y0, x1, y1) for i, x0, y0, x1, y1 in lines], "doc_id long, page int, line_no int, text string, x0 double, y0 double, x1 double, y1 double")
    rows = sorted(layout.stacks(df).collect(), key=lambda q: (q["stack"], q["place"]))
    found = {}
    for q in rows:
        found.setdefault(q["stack"], []).append(q["line_no"])
    assert {tuple(v) for v in found.values()} == plain_stacks(lines)


def test_kinsoku(spark):
    texts = ["「これは", "。悪い", "良い「", "終わり", "ー", "・一つ", "・二つ"]
    rows = [(1, 0, i, t, 10.0, 20.0 * i, 100.0, 20.0 * i + 12) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, page int, line_no int, text string, x0 double, y0 double, x1 double, y1 double")
    assert {(r["line_no"], r["problem"]) for r in layout.kinsoku(layout.stacks(df)).collect()} == {(1, "line-start"), (2, "line-end")}


def test_raster_against_plain_python(spark):
    r = random.Random(48)
    rows = [(bytes(r.randrange(256) for _ in range(n)), bytes(r.randrange(256) for _ in range(n)), k) for n, k in ((30, 3), (64, 1), (0, 3), (1300, 4))]
    df = spark.createDataFrame([(bytearray(a), bytearray(b), k) for a, b, k in rows], "a binary, b binary, n int")
    found = df.select(raster.dark_pixels("a", "n"), raster.changed_channels("a", "b", F.lit(16)), raster.difference_ratio("a", "b")).collect()
    for (a, b, n), row in zip(rows, found):
        assert row[0] == sum(1 for k in range(0, len(a), n) if a[k] < K.DARK_BELOW)
        assert row[1] == sum(abs(x - y) > 16 for x, y in zip(a, b))
        both, diff = sum((x | y).bit_count() for x, y in zip(a, b)), sum((x ^ y).bit_count() for x, y in zip(a, b))
        assert row[2] == (diff / both if both else 0.0)


def test_raster_decisions(spark):
    row = spark.range(1).select(raster.ink_status(F.lit(100), F.lit(39)), raster.ink_status(F.lit(10), F.lit(0)), raster.ink_status(F.lit(100), F.lit(300)), raster.shaping_verdict(F.lit(8), F.lit(8), F.lit(4), F.lit("Noto-Sans"), F.lit("noto sans"), F.lit("NotoSans")), raster.shaping_verdict(F.lit(8), F.lit(8), F.lit(8), F.lit("A"), F.lit("A"), F.lit("A"))).first()
    assert tuple(row) == ("FAIL", "SKIP", "PASS", "PASS", "FAIL")


def test_content_streams(spark):
    data = b"q 2 0 0 2 0 0 cm BT /F1 12 Tf 1 0 0 rg 10 20 Td (Hi (there)) Tj 0 -14 Td [(a) 3 (b)] TJ ET Q BT 1 0 0 1 5 5 Tm 3 Tr <41> Tj ET"
    df = spark.createDataFrame([(bytearray(data),)], "content binary")
    ops = [o["op"] for o in df.select(content.operators("content")).first()[0]]
    assert ops == "q cm BT Tf rg Td Tj Td TJ ET Q BT Tm Tr Tj ET".split()
    rows = [(1, 0, i, o) for i, o in enumerate(ops)]
    kept = content.stripped_ops(spark.createDataFrame(rows, "doc_id long, stream int, pos int, op string")).orderBy("pos").collect()
    assert [r["op"] for r in kept] == ["q", "cm", "rg", "Q"]
    states = df.select(content.shown_text_states("content")).first()[0]
    assert [(s["e"], s["f"], s["a"], s["mode"]) for s in states] == [(20.0, 40.0, 2.0, 0), (20.0, 12.0, 2.0, 0), (5.0, 5.0, 1.0, 3)]
    text = spark.createDataFrame([("/Span <</ActualText <FEFF00480069>>> BDC /ActualText<FFFE4800>",)], "t string")
    assert text.select(content.actual_texts(F.col("t"))).first()[0] == ["Hi", "H"]


def test_geometry_against_plain_python(spark):
    r = random.Random(3)
    boxes = [(1, 0, i, float(r.randrange(300)), float(r.randrange(300)), 0, 0) for i in range(80)]
    boxes = [(d, p, i, x, y, x + r.randrange(1, 90), y + r.randrange(1, 90)) for d, p, i, x, y, _, _ in boxes]
    df = spark.createDataFrame([(d, p, i, x0, y0, float(x1), float(y1)) for d, p, i, x0, y0, x1, y1 in boxes], "doc_id long, page int, id int, x0 double, y0 double, x1 double, y1 double")
    wanted = {(a[2], b[2]) for a in boxes for b in boxes if a[2] < b[2] and a[3] < b[5] and b[3] < a[5] and a[4] < b[6] and b[4] < a[6]}
    rows = [(x["a"], x["b"]) for x in geometry.overlaps(df).collect()]
    assert set(rows) == wanted and len(rows) == len(wanted)


def test_nearest_authored(spark):
    authored = spark.createDataFrame([(1, 1, 0, "a", 10.0, 10.0), (2, 1, 0, "a", 50.0, 10.0), (3, 1, 0, "a", 50.02, 10.0)], "aid int, doc_id long, page int, char string, x double, y double")
    glyphs = spark.createDataFrame([(7, 1, 0, "a", 10.04, 9.97), (8, 1, 0, "a", 50.01, 10.0), (9, 1, 0, "b", 10.0, 10.0)], "gid int, doc_id long, page int, char string, x double, y double")
    assert [tuple(x) for x in geometry.nearest_authored(glyphs, authored).collect()] == [(7, 1)]


def test_review_rules(spark):
    schema = "doc_id long, ord long, category string, severity string, resolution string, resolution_note string"
    rows = [(1, 0, "terminology", "major", "accepted with a fix: y", None), (1, 1, "style", "minor", "maybe", None), (1, 2, "colour", "minor", "open", None), (1, 3, "style", "huge", "open", None)]
    found = review.validated(spark.createDataFrame(rows, schema)).orderBy("ord").collect()
    assert [(r["error"], r["migrated"]) for r in found] == [(None, True), ("resolution", False), ("category", False), ("severity", False)]
    assert found[0]["resolution"] == "accepted" and found[0]["resolution_note"] == "accepted with a fix: y"


def test_occurrences_and_coverage(spark):
    occurrences = spark.createDataFrame([("s1", "Name", "Name de", ["r1", "r2"]), ("s2", "Name", "x", ["r3"]), ("s3", "Rent", "Miete", ["r4"])], "occurrence_id string, source_text string, target_text string, runs array<string>")
    findings = spark.createDataFrame([(0, "Name", "x", None, None), (1, "Name", "x", "s2", ["r3"]), (2, "Rent", "Miete", None, ["r9"]), (3, "None", "", None, None)], "finding_no int, core string, target string, occurrence_id string, source_runs array<string>")
    assert {r["finding_no"]: r["problem"] for r in review.matched_occurrences(findings, occurrences).collect()} == {0: "shared", 1: None, 2: "mismatch", 3: "unknown"}
    targets = spark.createDataFrame([("s1",), ("s1",), ("s9",), ("s3",)], "occurrence_id string")
    assert {(r["occurrence_id"], r["problem"]) for r in review.mapping_coverage(targets, occurrences).collect()} == {("s1", "duplicate"), ("s9", "unknown"), ("s2", "missing")}


def test_fonts(spark):
    row = spark.range(1).select(fonts.embedding_permission(F.lit(2)), fonts.embedding_permission(F.lit(0)), fonts.embedding_permission(F.lit(8)), fonts.observed_style(F.lit(700), F.lit(0), F.lit(0), F.lit(0.0))).first()
    assert tuple(row)[:3] == ("restricted", "installable", "editable") and row[3]["bold"]
    cmap = spark.createDataFrame([("f", 0x41, 5), ("f", 0x391, 5), ("f", 0x66, 6)], "font string, code int, gid int")
    lig = spark.createDataFrame([("f", 9, [0x66, 0x69]), ("f", 5, [0x41])], "font string, gid int, codes array<int>")
    assert {(r["gid"], r["text"]) for r in fonts.glyph_texts(cmap, lig).collect()} == {(5, "A"), (6, "f"), (9, "fi")}
    spans = spark.createDataFrame([(1, 0, "ABCDEF+Noto Sans-Bold"), (1, 0, "other")], "doc_id long, page int, font_name string")
    known = spark.createDataFrame([(1, 0, "f1", ["NotoSansBold", "x"])], "doc_id long, page int, font_id string, names array<string>")
    assert {r["font_name"]: r["candidates"] for r in fonts.candidates(spans, known).collect()} == {"ABCDEF+Noto Sans-Bold": ["f1"], "other": []}


def test_occurrence_join_against_plain_python(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(12)]
    texts = [(i, " ".join(r.choices(words, k=r.randrange(0, 60)))) for i in range(40)]
    items = [(i, " ".join(r.choices(words, k=k))) for i, k in enumerate((1, 2, 3, 9, 12, 2))] + [(9, texts[3][1][:40].rsplit(" ", 1)[0])]
    found = {(x["item_id"], x["doc_id"]) for x in parity.occurrences(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    wanted = {(i, d) for i, p in items for d, t in texts if p and f" {t} ".find(f" {p} ") >= 0}
    assert found >= wanted and all(dict(items)[i] in dict(texts)[d] for i, d in found)


def test_hypot_of_unit_direction(spark):
    from scriptorium.functions import text as T

    row = spark.range(1).select(T.unit_direction(F.lit(3.0), F.lit(4.0))).first()[0]
    assert np.isclose(row["x"], 0.6) and np.isclose(row["y"], 0.8)


def test_occurrences_inside_words_and_punctuation(spark):
    """Passages in quotes and brackets, before commas, inside words, short and empty ones, against plain containment."""
    phrases = ["one two three four", "alpha beta", "word", "a", "", "x  y\tz", "it ends here.", "é𝔘", "one two three four five six seven eight nine ten", "absent phrase stands nowhere", " lead", None]
    texts = ['He said "one two three four", then left.', "(one two three four)", "alphabeta (alpha beta)", "swordfish", "", "x  y\tz!", "x y z", "now it ends here.\"", "caféé𝔘n", "-one two three four five six seven eight nine ten,", "mis lead", None]
    p = spark.createDataFrame(list(enumerate(phrases)), "item_id int, text string")
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    wanted = sorted((i, d) for i, x in enumerate(phrases) for d, y in enumerate(texts) if x is not None and y is not None and x in y)
    assert sorted(map(tuple, parity.occurrences(t, p).collect())) == wanted


def test_row_limits_are_those_of_all_pairs(spark):
    """Random boxes against every pair: equal and crossing edges, thin, inverted and unowned boxes, owners of several."""
    r = random.Random(5)
    def box():
        x, y = r.randrange(60), r.randrange(70)
        sides = (x, y, x + r.choice([0, 0.5, 1, 3, 20]), y + r.choice([-3, 0, 1, 6, 30]))
        return [r.randrange(2), 0, None, *(None if r.random() < 0.05 else float(side) for side in sides)]

    segments = [[*row[:2], i, *row[3:]] for i, row in enumerate(box() for _ in range(150))]
    obstacles = [*([*s[:2], s[2] if s[2] % 5 else None, *s[3:]] for s in segments[:80]), *([*row[:2], r.randrange(150), *row[3:]] for row in (box() for _ in range(60)))]
    schema = "doc_id long, page int, {} long, x0 double, y0 double, x1 double, y1 double"
    widths = spark.createDataFrame([(0, 0, 90.0), (1, 0, 300.0)], "doc_id long, page int, width double")
    found = geometry.row_limits(spark.createDataFrame(segments, schema.format("id")), spark.createDataFrame(obstacles, schema.format("oid")), widths).collect()

    def limits(s):
        doc, _, i, x0, y0, x1, y1 = s
        row = [o for o in obstacles if o[0] == doc and o[2] != i and None not in (y0, y1, o[4], o[6]) and not (o[6] < y0 + 1 or o[4] > y1 - 1)]
        margin = (90.0, 300.0)[doc] - 32
        right = min([o[3] for o in row if None not in (o[3], x1) and o[3] > x1 - 1], default=margin)
        left = max([o[5] for o in row if None not in (o[5], x0) and o[5] < x0 + 1], default=32.0)
        return doc, i, min(margin, right) - 1.5, max(32.0, left) + 1.5

    assert sorted((f["doc_id"], f["id"], f["right_limit"], f["left_limit"]) for f in found) == sorted(map(limits, segments))
