"""Reading segment files, mappings, reviews, scale reports, termbases and PDF files; writing reports and dictionaries."""

from __future__ import annotations

import hashlib
import json


import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import constants as K
from scriptorium.functions.arrow import arrow_function
from scriptorium.operators import content

BOX = "array<double>"
SEGMENT = f"struct<id:int,page:int,bbox:{BOX},origin:{BOX},size:double,color:int,bold:boolean,italic:boolean,dir:{BOX},text:string,marker:string,gap:string,core:string,body_dx:double,dots:string,tail:string,passthrough:boolean,occurrence_id:string>"
WARNING = f"struct<kind:string,page:int,id:int,ids:array<int>,text:string,hit:string,lines:array<string>,width:double,right_edge:double,bbox:{BOX},fraction:double,why:string>"
DOCUMENT = "struct<lang:string,title:string,subject:string,keywords:string,outline:array<string>,marked:boolean,struct_tree:boolean>"
MAPPING = (
    "struct<lang:string,translations:map<string,string>,skip:array<string>,center:array<string>,right:array<string>,allow_scale:array<string>,"
    "allow_translate:array<string>,mirror:boolean,merges:array<struct<page:int,lines:array<string>,html:string,align:string,box:array<double>>>,"
    "overrides:array<struct<page:int,contains:string,parts:array<struct<text:string,x:double,max_width:double>>>>,"
    "notices:array<struct<page:int,text:string,box:array<double>,size:double>>>"
)
FINDING = "struct<core:string,target:string,category:string,subtype:string,severity:string,detail:string,suggestion:string,resolution:string,resolution_note:string,term:string,term_target:string,occurrence_id:string,source_runs:array<string>>"
RUN = "struct<page:int,key:string,ratio:double,occurrence_id:string>"


def _whole(spark: SparkSession, path: str, name: str, kind: str) -> DataFrame:
    """(doc_id, data, raw) of JSON files, one document each; data is null where the text is no such JSON."""
    files = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("doc_id"), F.col("value").alias("raw"))
    return files.withColumn(name, F.from_json("raw", kind, {"mode": "PERMISSIVE"}))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """SRC-16: one row a segment of segment files, flat, with its box's and origin's coordinates."""
    data = _whole(spark, path, "d", f"struct<segments:array<{SEGMENT}>>")
    s = data.select("doc_id", F.explode("d.segments").alias("s")).select("doc_id", "s.*")
    sides = [F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    return s.select("*", *sides, F.get("origin", F.lit(0)).alias("ox"), F.get("origin", F.lit(1)).alias("oy"))


def read_warnings(spark: SparkSession, path: str) -> DataFrame:
    data = _whole(spark, path, "d", f"struct<warnings:array<{WARNING}>>")
    return data.select("doc_id", F.posexplode("d.warnings").alias("warning_no", "w")).select("doc_id", "warning_no", "w.*")


def read_document_strings(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: the document block of segment files and its strings."""
    return _whole(spark, path, "d", f"struct<document:{DOCUMENT}>").select("doc_id", "d.document.*")


def read_mappings(spark: SparkSession, path: str) -> DataFrame:
    """SRC-15: mapping files, tolerant: a missing list is null, an odd file has null data."""
    return _whole(spark, path, "d", MAPPING).select("doc_id", "d.*")


def mapping_entries(mappings: DataFrame) -> DataFrame:
    """(doc_id, core, target): null targets, which are not authored, stay null."""
    return mappings.select("doc_id", F.explode("translations").alias("core", "target"))


def _strict(text: str | None) -> str | None:
    """Why a text is no strict JSON, or null: duplicate keys and numbers that are not finite are refused."""

    def pairs(items: list) -> dict:
        names = [k for k, _ in items]
        if len(set(names)) != len(names):
            raise ValueError(f"duplicate key {next(n for n in names if names.count(n) > 1)}")
        return dict(items)

    def refuse(value: str) -> None:
        raise ValueError(f"number {value}")

    try:
        json.loads(text or "", object_pairs_hook=pairs, parse_constant=refuse)
    except ValueError as error:
        return str(error)
    return None


@arrow_function("string")
def strict_json_error(text: pd.Series) -> pd.Series:
    """SRC-15: the strict decoder's refusal; null for valid text."""
    return text.map(_strict)


@arrow_function("string")
def canonical_digest(text: pd.Series) -> pd.Series:
    """MAP-1: SHA-256 of a JSON text's canonical form: sorted keys, no spaces, no numbers that are not finite."""

    def one(t: str | None) -> str | None:
        return None if t is None else hashlib.sha256(json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()

    return text.map(one)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """SRC-18: one row a finding of review files, in order, and one row with ``file_error`` for a file that cannot be
    read as a review: errors are data, nothing is raised."""
    data = _whole(spark, path, "d", f"struct<reviewer:struct<kind:string,name:string,qualified_in_pair:boolean>,findings:array<{FINDING}>>")
    rows = data.select("doc_id", F.col("d.reviewer").alias("reviewer"), F.posexplode_outer("d.findings").alias("ord", "f"), F.col("d.findings").isNull().alias("_none"))
    error = F.when(F.col("reviewer").isNull(), "no reviewer").when(F.col("_none"), "no findings list")
    return rows.select("doc_id", "ord", "f.*", error.alias("file_error"))


def scale_runs(text: Column) -> Column:
    """SRC-19: the runs of a scale report in either shape: a bare list, or an object of schema 1 or 2; null for none."""
    envelope = F.from_json(text, f"struct<schema:int,runs:array<{RUN}>>")
    runs = F.when(F.ltrim(text).startswith("["), F.from_json(text, f"array<{RUN}>")).when(envelope["schema"].isin(1, 2), envelope["runs"])
    return runs


def read_scale_reports(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, runs): null runs mean there is nothing to read, an empty list that nothing was scaled."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("doc_id"), scale_runs(F.col("value")).alias("runs"))


def read_termbase(spark: SparkSession, path: str) -> DataFrame:
    """SRC-17: (source, target, ord) of termbase files: two columns at least, trimmed, blanks left out, and a header
    row left out where it is the first row kept. Row order is the file's, so each file is read whole."""
    header = ("source", "source term", "term")

    def rows(files):
        import csv
        import io

        for frame in files:
            out = []
            for content in frame["content"]:
                kept: list[tuple[str, str]] = []
                for row in csv.reader(io.StringIO(bytes(content).decode("utf-8-sig"), newline="")):
                    if len(row) >= 2 and row[0].strip() and row[1].strip() and (kept or row[0].strip().lower() not in header):
                        kept.append((row[0].strip(), row[1].strip()))
                out.extend((s, t, i) for i, (s, t) in enumerate(kept))
            yield pd.DataFrame(out, columns=["source", "target", "ord"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "source string, target string, ord long")


def read_pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1: (doc_id, content) of PDF files, for the content-stream operators."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select(F.col("path").alias("doc_id"), "content")


def characters_of(raw: DataFrame) -> DataFrame:
    """SRC-2: (doc_id, page, block, line, char_no, c, x, y) of nested character pages (blocks > lines > spans > chars)."""
    b = raw.select("doc_id", "page", F.posexplode("blocks").alias("block", "b"))
    li = b.select("doc_id", "page", "block", F.posexplode("b.lines").alias("line", "l"))
    chars = F.flatten(F.transform("l.spans", lambda s: s["chars"]))
    c = li.select("doc_id", "page", "block", "line", F.posexplode(chars).alias("char_no", "ch"))
    return c.select("doc_id", "page", "block", "line", "char_no", F.col("ch.c").alias("c"), F.get("ch.origin", F.lit(0)).alias("x"), F.get("ch.origin", F.lit(1)).alias("y"))


def page_filter(spec: str | None, page: Column, pages: Column | None = None) -> Column:
    """SRC-5: a page-range such as ``1-4,9,12-`` (from 1, open ends allowed) as a filter on 0-based pages; null is all.

    A filter on a column, so it reaches the scan, and prunes partitions where the table is partitioned by page.
    """
    if not spec:
        return F.lit(True)
    out = F.lit(False)
    for part in filter(None, (p.strip() for p in spec.split(","))):
        first, dash, last = part.partition("-")
        low = int(first) - 1 if first else 0
        inside = page >= low if dash and not last else (page >= low) & (page <= int(last or first) - 1)
        out = out | inside
    return out if pages is None else out & (page < pages)


def widget_strings(widgets: DataFrame) -> DataFrame:
    """SRC-6: (doc_id, field, slot, export, text) of widgets (doc_id, name, tooltip, value, default, options array of
    (export, display))."""
    slots = F.array(*(F.struct(F.lit(s).alias("slot"), F.lit(None).cast("string").alias("export"), F.col(c).alias("text")) for s, c in (("tooltip", "tooltip"), ("value", "value"), ("default", "default"))))
    options = F.transform(F.coalesce("options", F.array().cast("array<struct<export:string,display:string>>")), lambda o: F.struct(F.lit("option").alias("slot"), o["export"].alias("export"), o["display"].alias("text")))
    out = widgets.select("doc_id", F.col("name").alias("field"), F.explode(F.concat(slots, options)).alias("s"))
    return out.select("doc_id", "field", "s.slot", "s.export", "s.text").filter("text is not null and text <> ''")


def write_segments(segments: DataFrame, path: str) -> None:
    """SNK-1: segments as Parquet, one directory a page number, so a page range reads only its pages."""
    segments.write.mode("overwrite").partitionBy("page").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """SNK-2: a JSON report; the committer makes it appear whole, or not at all."""
    report.write.mode("overwrite").json(path)


def write_scaffold(cores: DataFrame, path: str, force: bool = False) -> None:
    """SNK-4: a dictionary to be authored: every core with a null target; an existing one is kept unless forced."""
    cores.select("text", "count", F.lit(None).cast("string").alias("target")).write.mode("overwrite" if force else "errorifexists").option("ignoreNullFields", False).json(path)


def is_authored(text: Column) -> Column:
    """SNK-3: whether a widget scaffold (JSON text) already holds an authored target."""
    return F.size(F.regexp_extract_all(text, F.lit(r'"target"\s*:\s*("(?:[^"\\]|\\.)*+")'), F.lit(1))) > 0


def pdf_operators(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1: (doc_id, stream, pos, op, operands) of the content streams of PDF files, files spread over the tasks."""
    streams = read_pdf_files(spark, path).select("doc_id", F.posexplode(content.flate_streams("content")).alias("stream", "s"))
    return streams.select("doc_id", "stream", F.posexplode(content.operators("s")).alias("pos", "o")).select("doc_id", "stream", "pos", "o.op", "o.operands")


def pushbutton_captions(widgets: DataFrame, hidden: bool | None = None) -> DataFrame:
    """SRC-9: (doc_id, name, caption) of pushbuttons with a caption; ``hidden`` keeps only hidden ones, or only shown."""
    out = widgets.filter((F.col("flags").bitwiseAND(K.PUSHBUTTON_BIT) != 0) & (F.trim("caption") != ""))
    if hidden is not None:
        out = out.filter((F.col("annotation_flags").bitwiseAND(K.HIDDEN_BIT) != 0) == hidden)
    return out.select("doc_id", "name", F.trim("caption").alias("caption"))


def page_geometry(pages: DataFrame) -> DataFrame:
    """SRC-14: (doc_id, page, media_box, crop_box, rotation, width, height) with the effective box's size as it is seen:
    sides change places on a quarter turn."""
    side = lambda i: F.get("crop_box", F.lit(i + 2)) - F.get("crop_box", F.lit(i))
    turned = F.pmod(F.col("rotation"), F.lit(180)) == 90
    return pages.select("doc_id", "page", "media_box", "crop_box", "rotation", F.when(turned, side(1)).otherwise(side(0)).alias("width"), F.when(turned, side(0)).otherwise(side(1)).alias("height"))


def read_widget_mappings(spark: SparkSession, path: str) -> DataFrame:
    """SRC-20: (doc_id, field, slot, export, source, target, problem) of widget-text mapping files, discovered by name
    under ``path``; a file that is no JSON object has one row with a problem."""
    pair = "struct<source:string,target:string>"
    entry = f"struct<tooltip:{pair},value:{pair},`default`:{pair},options:array<struct<export:string,source:string,target:string>>>"
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "widget_text*.json").text(path)
    data = files.select(F.input_file_name().alias("doc_id"), F.from_json("value", f"map<string,{entry}>").alias("m"))
    bad = data.filter("m is null").select("doc_id", *(F.lit(None).cast("string").alias(c) for c in ("field", "slot", "export", "source", "target")), F.lit("not a JSON object").alias("problem"))
    e = data.select("doc_id", F.explode("m").alias("field", "e"))
    slot = lambda s: F.struct(F.lit(s).alias("slot"), F.lit(None).cast("string").alias("export"), F.col(f"e.{s}.source").alias("source"), F.col(f"e.{s}.target").alias("target"))
    options = F.transform(F.coalesce("e.options", F.array().cast("array<struct<export:string,source:string,target:string>>")), lambda o: F.struct(F.lit("option").alias("slot"), o["export"].alias("export"), o["source"].alias("source"), o["target"].alias("target")))
    rows = e.select("doc_id", "field", F.explode(F.concat(F.array(*(slot(s) for s in ("tooltip", "value", "default"))), options)).alias("s"))
    return rows.select("doc_id", "field", "s.*", F.lit(None).cast("string").alias("problem")).filter("source is not null").unionByName(bad)


def append_termbase(merged: DataFrame, path: str) -> None:
    """SNK-6: the added pairs of a termbase merge as a new CSV file of the termbase; conflicts are never written.

    Sources that the folder already has are left out, so a call that is tried again adds nothing."""
    spark = merged.sparkSession
    added = merged.filter("action = 'added'").select("ord", F.col("source").alias("source term"), F.col("target").alias("target term"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        there = spark.read.schema("`source term` string, `target term` string").option("header", True).csv(path)
        added = added.join(there.select("source term").distinct(), "source term", "left_anti")
    added.orderBy("ord").select("source term", "target term").coalesce(1).write.mode("append").option("header", True).csv(path)


def write_review_state(verdicts: DataFrame, path: str, run_at: str) -> None:
    """SNK-7: the state of review of every job (doc_id, present, review_line, blocks_delivery, counts) as JSON, written
    anew on each run with the time of the run; jobs without a review are written too."""
    verdicts.withColumn("run_at", F.lit(run_at)).write.mode("overwrite").json(path)


def write_bundle(tables: dict[str, DataFrame], path: str, captured_at: str) -> None:
    """SNK-8: a capture: each table as JSON in a folder of its own, then a manifest that names them. The manifest comes
    last, so a bundle with one is whole."""
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    rows = [(captured_at, name, ",".join(table.columns)) for name, table in tables.items()]
    spark.createDataFrame(rows, "captured_at string, name string, columns string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
