"""Validation of extractions, font resolutions, target runs and scale exceptions: one row a broken rule, nothing raised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import scripts as S
from scriptorium.functions import text as T

# Style classes and the faces of a set.
CLASSES = ("serif", "sans")
FACES = ("regular", "bold", "italic", "bold_italic")


def odd_numbers(values: Column, n: int) -> Column:
    """Whether an array is not n finite numbers."""
    return F.coalesce(F.size(values) != n, F.lit(True)) | F.coalesce(F.exists(values, odd_number), F.lit(True))


def odd_number(value: Column) -> Column:
    return value.isNull() | F.isnan(value) | (F.abs(value.cast("double")) == float("inf"))


def odd_ink(size: Column, color: Column) -> Column:
    """Whether a size is not finite and positive, or a colour not one of 24 bits."""
    return odd_number(size) | (size <= 0) | color.isNull() | (color < 0) | (color > 0xFFFFFF)


def broken(rules: dict[str, Column]) -> Column:
    """The names of the rules whose test is true."""
    return F.filter(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items())), lambda r: r.isNotNull())


def face(bold: Column, italic: Column) -> Column:
    return F.when(bold & italic, FACES[3]).when(italic, FACES[2]).when(bold, FACES[1]).otherwise(FACES[0])


def context_violations(extractions: DataFrame, boxes: DataFrame, fields: DataFrame, fonts: DataFrame) -> DataFrame:
    """MAP-2: (doc_id, part, place, rule) broken rules of what an extraction says beside its segments.

    extractions (doc_id, schema, extraction_id, digest, expected, source_sha256, title, outline, gap, option_pages,
    pages); boxes (doc_id, place, page, media_box, crop_box, effective_box, rotation), the pages in their order; fields
    (doc_id, place, page, name, type, rect); fonts (doc_id, font_id, class, bold, italic). A value of another JSON type
    is null in a typed reader, and a null breaks its rule, but for a font's unknown weight and slant. An extraction
    without boxes has no page that may be selected. Page counts are a partial aggregate; the joins are by doc_id.
    """
    counts = boxes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    none = F.array().cast("array<int>")
    there = F.coalesce(F.col("_n"), F.lit(0))
    stray = F.exists("pages", lambda p: p.isNull() | (p < 0) | (p >= there))
    whole = {
        "schema": ~F.col("schema").eqNullSafe(F.lit(1)),
        "identity": ~(F.col("digest").eqNullSafe(F.col("expected")) & F.col("digest").eqNullSafe(F.col("extraction_id"))) | F.col("digest").isNull(),
        "source-digest": ~F.coalesce(F.col("source_sha256").rlike("^[a-f0-9]{64}$"), F.lit(False)),
        "title": F.col("title").isNull(),
        "outline": F.col("outline").isNull() | F.exists("outline", lambda t: t.isNull()),
        "gap": odd_number(F.col("gap")),
        "pages": F.col("pages").isNull() | stray | ~F.col("pages").eqNullSafe(F.array_sort(F.array_distinct(F.coalesce("pages", none)))),
        "option-pages": ~F.col("option_pages").eqNullSafe(F.col("pages")),
    }
    page = {
        "page": ~F.col("page").eqNullSafe(F.col("place")),
        "media-box": odd_numbers(F.col("media_box"), 4),
        "crop-box": odd_numbers(F.col("crop_box"), 4),
        "effective-box": odd_numbers(F.col("effective_box"), 4),
        "rotation": F.col("rotation").isNull(),
    }
    field = {
        "page": F.col("page").isNull() | (F.col("page") < 0) | (F.col("page") >= there),
        "name": F.col("name").isNull(),
        "type": F.col("type").isNull(),
        "rect": odd_numbers(F.col("rect"), 4),
    }
    font = {
        "font-id": ~F.coalesce(F.col("font_id").rlike("^f[0-9]+$"), F.lit(False)),
        "class": ~F.coalesce(F.col("class").isin(*CLASSES, "unknown"), F.lit(False)),
    }
    parts = (
        ("extraction", extractions.join(counts, "doc_id", "left"), F.lit(None).cast("string"), whole),
        ("page", boxes, F.col("place").cast("string"), page),
        ("field", fields.join(counts, "doc_id", "left"), F.col("place").cast("string"), field),
        ("font", fonts, F.col("font_id"), font),
    )
    rows = [df.select("doc_id", F.lit(name).alias("part"), place.alias("place"), F.explode(broken(rules)).alias("rule")) for name, df, place, rules in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def _resolutions_with_fonts(fonts: DataFrame, resolutions: DataFrame) -> DataFrame:
    seen = fonts.select("doc_id", "font_id", F.lit(True).alias("_known"), *(F.col(c).alias(f"_{c}") for c in ("class", "bold", "italic")))
    return resolutions.join(seen, ["doc_id", "font_id"], "left").withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "font_id")))


def resolution_violations(fonts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """JOIN-26: (doc_id, font_id, rule) resolutions (doc_id, font_id, class, bold, italic, reason) of source fonts
    (doc_id, font_id, class, bold, italic) that name no font or one twice, are incomplete, contradict what was
    observed, or resolve nothing. A window over one font's resolutions finds those given twice."""
    unseen = {"class": F.col("_class").isNull() | (F.col("_class") == "unknown"), "bold": F.col("_bold").isNull(), "italic": F.col("_italic").isNull()}
    known = F.col("_known").isNotNull()
    rules = {
        "foreign": ~known,
        "duplicate": F.col("_same") > 1,
        "class": ~F.coalesce(F.col("class").isin(*CLASSES), F.lit(False)),
        "flags": F.col("bold").isNull() | F.col("italic").isNull(),
        "reason": T.strip(F.coalesce("reason", F.lit(""))) == "",
        **{f"conflict-{c}": known & ~unknown & (F.col(f"_{c}") != F.col(c)) for c, unknown in unseen.items()},
        "needless": known & ~unseen["class"] & ~unseen["bold"] & ~unseen["italic"],
    }
    return _resolutions_with_fonts(fonts, resolutions).select("doc_id", "font_id", F.explode(broken(rules)).alias("rule"))


def resolved_fonts(fonts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """JOIN-26: fonts with what their resolution says where the observation is unknown; of several the least."""
    one = resolutions.groupBy("doc_id", "font_id").agg(F.min(F.struct("class", "bold", "italic")).alias("_r"))
    seen = F.when(F.col("class") != "unknown", F.col("class"))
    return fonts.join(one, ["doc_id", "font_id"], "left").select(
        "doc_id", "font_id", F.coalesce(seen, F.col("_r.class"), F.col("class")).alias("class"), F.coalesce("bold", "_r.bold").alias("bold"), F.coalesce("italic", "_r.italic").alias("italic")
    )


def target_violations(targets: DataFrame, segments: DataFrame, fonts: DataFrame, faces: DataFrame) -> DataFrame:
    """JOIN-26: (doc_id, occurrence_id, rule) broken rules of authored runs against the source's.

    targets (doc_id, occurrence_id, runs array<struct<text, source_runs>>); segments (doc_id, occurrence_id, text,
    style_runs array<struct<run_id, text, font_id>>); fonts as resolved; faces (doc_id, class, role), the target faces of
    a document's job. An occurrence is authored once, and all are; a run has a plain text and names its own occurrence's
    runs, each once, of one resolved style whose face is there; no source run with letters is left out. References
    meet runs by document, occurrence and name, so no document is gathered; a rule is one row an occurrence.
    """
    numbered = targets.select("doc_id", "occurrence_id", "runs", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "occurrence_id")).alias("_same"))
    source = segments.select("doc_id", "occurrence_id", F.col("text").alias("_text"), F.lit(True).alias("_known"))
    listed = F.coalesce("runs", F.array().cast(dict(targets.dtypes)["runs"]))
    blank = lambda t: T.strip(F.coalesce(t, F.lit(""))) == ""
    own = {
        "duplicate": F.col("_same") > 1,
        "unknown": F.col("_known").isNull(),
        "source-text": ~S.is_plain_text(F.col("_text")),
        "no-runs": F.size(listed) == 0,
        "empty-run": F.exists(listed, lambda r: blank(r["text"])),
        "run-text": F.exists(listed, lambda r: ~S.is_plain_text(r["text"])),
        "references": F.exists(listed, lambda r: r["source_runs"].isNull() | (F.size(r["source_runs"]) == 0) | F.exists(r["source_runs"], lambda n: n.isNull()) | (F.size(F.array_distinct(r["source_runs"])) != F.size(r["source_runs"]))),
    }
    direct = numbered.join(source, ["doc_id", "occurrence_id"], "left").select("doc_id", "occurrence_id", F.explode(broken(own)).alias("rule"))
    missing = source.join(targets.select("doc_id", "occurrence_id"), ["doc_id", "occurrence_id"], "left_anti").select("doc_id", "occurrence_id", F.lit("missing").alias("rule"))

    styles = fonts.join(faces.select("doc_id", "class", "role", F.lit(True).alias("_face")).distinct().withColumnRenamed("role", "_role"), ["doc_id", "class"], "left")
    has_face = F.coalesce(F.bool_or(F.col("_face") & (F.col("_role") == face(F.col("bold"), F.col("italic")))), F.lit(False))
    styles = styles.groupBy("doc_id", "font_id", "class", "bold", "italic").agg(has_face.alias("_has"))
    resolved = F.col("class").isin(*CLASSES) & F.col("bold").isNotNull() & F.col("italic").isNotNull()
    runs = segments.select("doc_id", "occurrence_id", F.explode("style_runs").alias("r")).select("doc_id", "occurrence_id", F.col("r.run_id").alias("run_id"), F.col("r.font_id").alias("font_id"), blank(F.col("r.text")).alias("_blank"))
    styled = runs.join(styles, ["doc_id", "font_id"], "left").select("doc_id", "occurrence_id", "run_id", "_blank", F.when(F.coalesce(resolved, F.lit(False)), F.concat_ws("/", "class", face(F.col("bold"), F.col("italic")))).alias("_style"), F.coalesce("_has", F.lit(False)).alias("_has"), F.lit(True).alias("_run"))

    asked = targets.select("doc_id", "occurrence_id", F.posexplode("runs").alias("_no", "r")).select("doc_id", "occurrence_id", "_no", F.explode("r.source_runs").alias("run_id"))
    met = asked.join(styled, ["doc_id", "occurrence_id", "run_id"], "left").join(source.select("doc_id", "occurrence_id"), ["doc_id", "occurrence_id"], "left_semi")
    by_run = met.groupBy("doc_id", "occurrence_id", "_no").agg(
        F.bool_or(F.col("_run").isNull()).alias("foreign-run"),
        F.bool_or(F.col("_run").isNotNull() & F.col("_style").isNull()).alias("unresolved-style"),
        (F.min("_style") != F.max("_style")).alias("mixed-styles"),
        F.bool_or(F.col("_style").isNotNull() & ~F.col("_has")).alias("missing-face"),
    )
    names = ["foreign-run", "unresolved-style", "mixed-styles", "missing-face"]
    referred = by_run.select("doc_id", "occurrence_id", F.explode(broken({n: F.col(f"`{n}`") for n in names})).alias("rule")).distinct()
    authored = targets.select("doc_id", "occurrence_id").distinct()
    left_out = styled.filter(~F.col("_blank")).join(authored, ["doc_id", "occurrence_id"], "left_semi").join(asked, ["doc_id", "occurrence_id", "run_id"], "left_anti")
    omitted = left_out.select("doc_id", "occurrence_id", F.lit("omitted-run").alias("rule")).distinct()
    return direct.distinct().unionByName(missing).unionByName(referred).unionByName(omitted)


def scale_violations(scales: DataFrame, segments: DataFrame) -> DataFrame:
    """JOIN-26: (doc_id, occurrence_id, rule) scale exceptions (doc_id, occurrence_id, reason) for no occurrence, given
    twice, or without a reason."""
    known = segments.select("doc_id", "occurrence_id", F.lit(True).alias("_known")).distinct()
    rules = {"unknown": F.col("_known").isNull(), "duplicate": F.col("_same") > 1, "reason": T.strip(F.coalesce("reason", F.lit(""))) == ""}
    counted = scales.withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "occurrence_id")))
    return counted.join(known, ["doc_id", "occurrence_id"], "left").select("doc_id", "occurrence_id", F.explode(broken(rules)).alias("rule")).distinct()
