"""Files in and out, and streams that end with what the batch query gives."""

import json
import zlib

from pyspark.sql import functions as F

from scriptorium.operators import content
from scriptorium.sources import documents as src
from scriptorium.streaming import jobs
from scriptorium.tables import table

SEGMENTS = {
    "document": {"lang": "en", "title": "Form", "outline": ["One"]},
    "segments": [{"id": 0, "page": 0, "bbox": [1, 2, 3, 4], "origin": [1, 4], "size": 10, "text": "Hello", "core": "Hello", "passthrough": False}],
    "warnings": [{"kind": "merge-candidate", "page": 0, "ids": [0, 1]}],
}


def test_segment_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(SEGMENTS))
    (tmp_path / "b.json").write_text("{ not json")
    rows = src.read_segments(spark, str(tmp_path)).collect()
    assert [(r["id"], r["x0"], r["oy"], r["core"]) for r in rows] == [(0, 1.0, 4.0, "Hello")]
    assert src.read_warnings(spark, str(tmp_path)).first()["ids"] == [0, 1]
    assert src.read_document_strings(spark, str(tmp_path)).filter("title is not null").first()["outline"] == ["One"]


def test_mappings_and_strictness(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"lang": "de", "translations": {"a": "b", "c": None}, "skip": ["x"]}))
    entries = src.mapping_entries(src.read_mappings(spark, str(tmp_path))).collect()
    assert {(r["core"], r["target"]) for r in entries} == {("a", "b"), ("c", None)}
    texts = spark.createDataFrame([('{"a": 1, "a": 2}',), ('{"a": NaN}',), ('{"b": 1, "a": [2]}',)], "t string")
    assert [bool(r[0]) for r in texts.select(src.strict_json_error("t")).collect()] == [True, True, False]
    two = spark.createDataFrame([('{"b": 1, "a": [2]}',), ('{ "a":[2],"b":1}',)], "t string")
    assert two.select(src.canonical_digest("t").alias("d")).distinct().count() == 1


def test_termbase(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("﻿Source Term,Target\r\nrent,Miete\r\n,x\r\nterm,Begriff\r\n\"a, b\",c,extra\r\n".encode())
    assert [(r["source"], r["target"]) for r in src.read_termbase(spark, str(tmp_path)).orderBy("ord").collect()] == [("rent", "Miete"), ("term", "Begriff"), ("a, b", "c")]


def test_scale_reports_and_reviews(spark, tmp_path):
    for name, text in (("a", '[{"page": 1, "key": "x", "ratio": 0.8}]'), ("b", '{"schema": 1, "runs": []}'), ("c", '{"schema": 7, "runs": []}'), ("d", "nonsense")):
        (tmp_path / f"{name}.json").write_text(text)
    sizes = {r["doc_id"][-6:-5]: r["n"] for r in src.read_scale_reports(spark, str(tmp_path)).select("doc_id", F.expr("case when runs is null then -1 else size(runs) end").alias("n")).collect()}
    assert sizes == {"a": 1, "b": 0, "c": -1, "d": -1}
    folder = tmp_path / "reviews"
    folder.mkdir()
    (folder / "r.json").write_text(json.dumps({"reviewer": {"name": "R"}, "findings": [{"core": "a", "resolution": "open"}]}))
    (folder / "s.json").write_text("{}")
    errors = {r["doc_id"][-6]: r["file_error"] for r in src.read_reviews(spark, str(folder)).collect()}
    assert errors == {"r": None, "s": "no reviewer"}


def test_page_ranges(spark):
    pages = spark.range(12).select(F.col("id").cast("int").alias("page"))
    keep = lambda spec: [r["page"] for r in pages.filter(src.page_filter(spec, F.col("page"))).orderBy("page").collect()]
    assert keep("1-3,9,12-") == [0, 1, 2, 8, 11] and keep(None) == list(range(12)) and keep("-2") == [0, 1]


def test_pdf_streams(spark, tmp_path):
    body = zlib.compress(b"BT (x) Tj ET")
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\n1 0 obj <</Length 9>> stream\n" + body + b"\nendstream endobj")
    streams = src.read_pdf_files(spark, str(tmp_path)).select(F.explode(content.flate_streams("content")).alias("s"))
    assert bytes(streams.first()["s"]) == b"BT (x) Tj ET"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2)], "text string, count long")
    src.write_scaffold(rows, str(tmp_path / "s"))
    again = spark.read.schema("text string, count long, target string").json(str(tmp_path / "s")).first()
    assert again["target"] is None and again["count"] == 2
    flags = spark.createDataFrame([('{"target": null}',), ('{"target": "x"}',)], "t string").select(src.is_authored(F.col("t"))).collect()
    assert [r[0] for r in flags] == [False, True]


def test_stream_windows_equal_the_batch(spark, smallest, tmp_path):
    events = table(spark, smallest, "events")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = jobs.event_windows(jobs.arriving(spark, str(tmp_path / "in"), events.schema), "1 hour", late="1000 days")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda df: {(r["start"], r["event_type"], r["n"]) for r in df.collect()}
    assert key(spark.table("windows")) == key(jobs.event_windows(events, "1 hour"))


def test_stream_of_pairs(spark, tmp_path):
    pairs = spark.createDataFrame([("Due 1", "Bis 2"), ("ok then", "gut so")], "core string, target string")
    pairs.write.parquet(str(tmp_path / "pairs"))
    stream = jobs.qa_findings(jobs.arriving(spark, str(tmp_path / "pairs"), pairs.schema))
    jobs.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert [r["kind"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["numbers"]


def test_operators_of_pdf_files(spark, tmp_path):
    for name, text in (("a", b"BT (x) Tj ET 1 0 0 rg"), ("b", b"q Q")):
        (tmp_path / f"{name}.pdf").write_bytes(b"stream\n" + zlib.compress(text) + b"\nendstream")
    rows = src.pdf_operators(spark, str(tmp_path)).orderBy("doc_id", "pos").collect()
    assert [r["op"] for r in rows] == ["BT", "Tj", "ET", "rg", "q", "Q"]
    assert [r["op"] for r in content.stripped_ops(src.pdf_operators(spark, str(tmp_path))).orderBy("doc_id", "pos").collect()] == ["rg", "q", "Q"]


def test_buttons_and_pages(spark):
    button = 1 << 16
    w = spark.createDataFrame([(1, "a", "Print ", button, 0), (1, "b", "Hide", button, 2), (1, "c", "Text", 0, 0), (1, "d", " ", button, 0)], "doc_id long, name string, caption string, flags int, annotation_flags int")
    assert {r["name"] for r in src.pushbutton_captions(w).collect()} == {"a", "b"}
    assert {r["name"] for r in src.pushbutton_captions(w, hidden=True).collect()} == {"b"}
    p = spark.createDataFrame([(1, 0, [0.0, 0.0, 10.0, 20.0], [1.0, 2.0, 10.0, 20.0], 90)], "doc_id long, page int, media_box array<double>, crop_box array<double>, rotation int")
    assert [(r["width"], r["height"]) for r in src.page_geometry(p).collect()] == [(18.0, 9.0)]


def test_widget_mappings(spark, tmp_path):
    entry = {"name": {"tooltip": {"source": "Name", "target": None}, "options": [{"export": "a", "source": "A", "target": "B"}]}}
    (tmp_path / "widget_text.json").write_text(json.dumps(entry))
    (tmp_path / "widget_text_2.json").write_text("[1]")
    (tmp_path / "other.json").write_text("{}")
    rows = {(r["field"], r["slot"], r["export"], r["source"], r["target"], r["problem"]) for r in src.read_widget_mappings(spark, str(tmp_path)).collect()}
    assert rows == {("name", "tooltip", None, "Name", None, None), ("name", "option", "a", "A", "B", None), (None, None, None, None, None, "not a JSON object")}


def test_termbase_grows_once(spark, tmp_path):
    from scriptorium.operators import review

    path = str(tmp_path / "terms")
    rows = spark.createDataFrame([("rent", "Miete", 0), ("rent", "Zins", 1), ("land", "Land", 2)], "source string, target string, ord long")
    empty = spark.createDataFrame([], "source string, target string, ord long")
    src.append_termbase(review.termbase_merge(empty, rows), path)
    again = src.read_termbase(spark, f"{path}/*.csv")
    assert {(r["source"], r["target"]) for r in again.collect()} == {("rent", "Miete"), ("land", "Land")}
    assert review.termbase_merge(again, rows).filter("action = 'added'").count() == 0
    assert review.termbase_merge(again, rows).filter("action = 'conflict'").count() == 1


def test_bundles(spark, tmp_path):
    src.write_bundle({"runs": spark.createDataFrame([("a", 0.5)], "key string, ratio double")}, str(tmp_path / "b"), "2024-01-01T00:00:00Z")
    assert spark.read.json(str(tmp_path / "b" / "manifest")).first()["name"] == "runs"
    assert spark.read.json(str(tmp_path / "b" / "runs")).first()["ratio"] == 0.5
