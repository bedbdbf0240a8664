"""Font metadata decisions: observed flags, embedding permission, glyph names of authored text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as T


def fonts_in_use(fonts: Column, drawn: Column) -> Column:
    """SET-4: the configured fonts (keys of a map) that something is drawn in, sorted."""
    return F.array_sort(F.array_intersect(F.map_keys(fonts), drawn))


def observed_style(weight: Column, selection: Column, mac_style: Column, angle: Column) -> Column:
    """SRC-10: bold and italic as a font program's tables state them: weight class and selection bits, then style bits
    and slant where those tables are absent."""
    bold = F.coalesce((selection.bitwiseAND(32) != 0) | (weight >= 600), mac_style.bitwiseAND(1) != 0, F.lit(False))
    italic = F.coalesce(selection.bitwiseAND(1) != 0, mac_style.bitwiseAND(2) != 0, F.lit(False)) | (F.coalesce(angle, F.lit(0.0)) != 0)
    return F.struct(bold.alias("bold"), italic.alias("italic"))


def embedding_permission(fs_type: Column) -> Column:
    """FNT-2: what a font's licence bits allow: the least restrictive of the set usage bits counts."""
    usage = fs_type.bitwiseAND(0xE)
    return F.when(fs_type.isNull(), "unknown").when(usage == 0, "installable").when(usage.bitwiseAND(8) != 0, "editable").when(usage.bitwiseAND(4) != 0, "preview").otherwise("restricted")


def validation_reason(fonts: DataFrame) -> DataFrame:
    """FNT-3: fonts (readable, permission, n_missing, bold, italic, want_bold, want_italic) with the first reason
    against using them, or null."""
    reason = (
        F.when(~F.col("readable"), "unreadable")
        .when(F.col("permission") == "restricted", "embedding-restricted")
        .when(F.col("n_missing") > 0, "missing-glyphs")
        .when(F.col("bold") != F.col("want_bold"), "weight-mismatch")
        .when(F.col("italic") != F.col("want_italic"), "slant-mismatch")
    )
    return fonts.withColumn("reason", reason)


def glyph_texts(cmap: DataFrame, ligatures: DataFrame) -> DataFrame:
    """FNT-1: (font, gid, text) the authored text of each glyph: its lowest code point (font, code, gid), or the joined
    code points of a ligature's parts (font, gid, codes)."""
    char = lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")
    single = cmap.groupBy("font", "gid").agg(F.min("code").alias("code")).select("font", "gid", char(F.col("code")).alias("text"))
    joined = ligatures.select("font", "gid", F.array_join(F.transform("codes", char), "").alias("text"))
    return single.unionByName(joined.join(single.select("font", "gid"), ["font", "gid"], "left_anti"))


def candidates(spans: DataFrame, fonts: DataFrame) -> DataFrame:
    """JOIN-22: spans (doc_id, page, font_name, ...) with the font ids (doc_id, page, font_id, names) one of whose names
    equals the span's, apart from subset tags, spaces and case."""
    aliases = fonts.select("doc_id", "page", "font_id", F.explode("names").alias("n")).select("doc_id", "page", "font_id", T.font_key(F.col("n")).alias("_key")).distinct()
    grouped = aliases.groupBy("doc_id", "page", "_key").agg(F.array_sort(F.collect_set("font_id")).alias("candidates"))
    out = spans.withColumn("_key", T.font_key(F.col("font_name"))).join(grouped, ["doc_id", "page", "_key"], "left").drop("_key")
    return out.withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))


def unmatched_faces(drawing: DataFrame, embedded: DataFrame) -> DataFrame:
    """JOIN-23: (doc_id, page, unmatched) fonts that draw on a page (names array) and are not embedded there."""
    keys = lambda c: F.transform(c, T.font_key)
    both = drawing.alias("d").join(embedded.alias("e"), ["doc_id", "page"], "left")
    rest = F.array_except(keys(F.col("d.names")), F.coalesce(keys(F.col("e.names")), F.array().cast("array<string>")))
    return both.select("doc_id", "page", rest.alias("unmatched")).filter(F.size("unmatched") > 0)


def job_charset(authored: DataFrame, fixed: str = "") -> DataFrame:
    """SCR-17: (char) what a job's fonts must cover: printable ASCII, every authored character but the weight split,
    and fixed marks. Distinct by a partial aggregate: the result is as small as the repertoire."""
    base = authored.sparkSession.range(0x20, 0x7F).select(F.char("id").alias("char"))
    chars = authored.select(F.explode(F.split(F.coalesce("text", F.lit("")), "")).alias("char")).filter("char <> '' and char <> '‖'")
    marks = authored.sparkSession.createDataFrame([(c,) for c in fixed] or [(" ",)], "char string")
    return base.unionByName(chars).unionByName(marks).distinct()
