"""Mappings as data: merge matching, validation of extractions and notices, unions of lists, proposals' folding in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import scripts as S
from scriptorium.functions import text as T
from scriptorium.operators.validation import broken, odd_ink, odd_numbers


def merge_matches(segments: DataFrame, merges: DataFrame) -> DataFrame:
    """JOIN-16: declared merges (doc_id, merge_no, page, lines) with the ids of the segments that spell their lines, in
    page order: (doc_id, merge_no, ids, n_lines, matched).

    Greedy: each line takes the first segment after the one before it whose stripped text equals it; a merge is
    matched if all lines are. A page's segments are folded in order, so a page is the unit of work.
    """
    page = segments.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("id", T.strip(F.col("text")).alias("line")))).alias("rows"))
    found = merges.join(page, ["doc_id", "page"], "left").withColumn("lines", F.transform("lines", T.strip))
    kind = "struct<at:int,ids:array<int>>"

    def step(acc: Column, row: Column) -> Column:
        fits = (acc["at"] < F.size("lines")) & (row["line"] == F.get("lines", acc["at"]))
        return F.when(fits, F.struct((acc["at"] + 1).alias("at"), F.concat(acc["ids"], F.array(row["id"])).alias("ids")).cast(kind)).otherwise(acc)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ids")).cast(kind)
    rows = F.coalesce("rows", F.array().cast("array<struct<id:int,line:string>>")).cast("array<struct<id:int,line:string>>")
    folded = found.withColumn("_f", F.aggregate(rows, start, step))
    return folded.select("doc_id", "merge_no", F.col("_f.ids").alias("ids"), F.size("lines").alias("n_lines"), (F.col("_f.at") == F.size("lines")).alias("matched"))


def with_body_offset(segments: DataFrame, characters: DataFrame) -> DataFrame:
    """PRJ-7: (doc_id, id, body_dx): distance along the line from a marked segment's origin to its body's first glyph.

    Characters (doc_id, page, line, char_no, c, x, y). The character within a point of the origin starts the segment;
    after white space the drawn characters must spell marker, gap and the body's first letter, else there is none.
    """
    marked = segments.filter("marker <> '' and core <> ''").withColumn("_want", F.concat("marker", "gap", F.substring("core", 1, 1)))
    line = characters.groupBy("doc_id", "page", "line").agg(F.sort_array(F.collect_list(F.struct("char_no", "c", "x", "y"))).alias("chars"))
    heads = characters.select("doc_id", "page", "line", "char_no", F.col("x").alias("hx"), F.col("y").alias("hy"))
    near = (F.abs(F.col("hx") - F.col("ox")) <= 1.0) & (F.abs(F.col("hy") - F.col("oy")) <= 1.0)
    first = marked.join(heads, ["doc_id", "page"]).filter(near).groupBy("doc_id", "page", "id", "ox", "oy", "dx", "dy", "marker", "gap", "_want").agg(F.min(F.struct("line", "char_no")).alias("h"))
    drawn = first.join(line.withColumnRenamed("line", "_line"), (first["doc_id"] == line["doc_id"]) & (first["page"] == line["page"]) & (F.col("h.line") == F.col("_line"))).select(first["*"], "chars")
    rest = drawn.withColumn("_rest", F.filter("chars", lambda c: c["char_no"] >= F.col("h.char_no")))
    blank = F.coalesce(F.array_position(F.transform("_rest", lambda c: ~c["c"].rlike(r"^\s$")), True) - 1, F.lit(0)).cast("int")
    seen = rest.withColumn("_from", blank).withColumn("_got", F.array_join(F.transform(F.slice("_rest", F.col("_from") + 1, F.length("_want")), lambda c: c["c"]), ""))
    body = F.get("_rest", F.col("_from") + F.length("marker") + F.length("gap"))
    offset = F.bround((body["x"] - F.col("ox")) * F.col("dx") + (body["y"] - F.col("oy")) * F.col("dy"), 2)
    return seen.select("doc_id", "id", F.when(F.col("_got") == F.col("_want"), offset).alias("body_dx"))


def extraction_violations(segments: DataFrame, pages: DataFrame, fonts: DataFrame) -> DataFrame:
    """MAP-2: (doc_id, id, rule) broken invariants of extracted segments (doc_id, id, occurrence_id, page, text, bbox,
    origin, dir, size, color, style_runs) against the selected pages (doc_id, page) and fonts (doc_id, font_id).

    Identities name the segment and are unique; pages are selected ones; geometry is finite and of its length; runs
    (run_id, text, offsets, origin, bbox, size, color, font_id) are named after their segment, tile the text by their
    offsets, spell it, have geometry of their own, and name no font that was not observed.
    """
    known = pages.select("doc_id", "page").distinct().withColumn("_known", F.lit(True))
    observed = fonts.groupBy("doc_id").agg(F.collect_set("font_id").alias("_fonts"))
    out = segments.join(known, ["doc_id", "page"], "left").join(observed, "doc_id", "left")
    out = out.withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "occurrence_id")))
    runs = F.coalesce("style_runs", F.array().cast(dict(segments.dtypes)["style_runs"]))
    tiled = F.aggregate(
        runs,
        F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok")),
        lambda acc, r: F.struct(
            (acc["at"] + F.length(r["text"])).alias("at"),
            (acc["ok"] & r["offsets"].eqNullSafe(F.array(acc["at"], acc["at"] + F.length(r["text"]))) & (F.substr(F.col("text"), acc["at"] + 1, F.length(r["text"])) == r["text"])).alias("ok"),
        ),
        lambda acc: acc["ok"] & (acc["at"] == F.length("text")),
    )
    names = F.transform(runs, lambda r: r["run_id"])
    named = lambda n: F.coalesce(n.startswith(F.concat("occurrence_id", F.lit("/r"))) & n.rlike("/r[0-9]+$") & (F.locate("/", n) == F.length("occurrence_id") + 1), F.lit(False))
    stray = lambda r: r["font_id"].isNotNull() & ~F.coalesce(F.array_contains("_fonts", r["font_id"]), F.lit(False))
    rules = {
        "identity": F.coalesce(F.col("id") < 0, F.lit(True)) | ~F.col("occurrence_id").eqNullSafe(F.concat(F.lit("s"), F.col("id").cast("string"))),
        "duplicate": F.col("_same") > 1,
        "page": F.col("_known").isNull(),
        "text": F.col("text").isNull(),
        "box": odd_numbers(F.col("bbox"), 4),
        "origin": odd_numbers(F.col("origin"), 2),
        "direction": odd_numbers(F.col("dir"), 2),
        "size": odd_ink(F.col("size"), F.lit(0)),
        "colour": odd_ink(F.lit(1.0), F.col("color")),
        "no-runs": F.size(runs) == 0,
        "run-names": (F.size(F.array_distinct(names)) != F.size(names)) | F.exists(names, lambda n: ~named(n)),
        "run-tiling": (F.size(runs) > 0) & ~F.coalesce(tiled, F.lit(False)),
        "run-geometry": F.exists(runs, lambda r: odd_numbers(r["origin"], 2) | odd_numbers(r["bbox"], 4) | F.coalesce(odd_ink(r["size"], r["color"]), F.lit(True))),
        "run-font": F.exists(runs, stray),
    }
    return out.select("doc_id", "id", F.explode(broken(rules)).alias("rule"))


def notice_violations(notices: DataFrame, page_counts: DataFrame) -> DataFrame:
    """PLC-6: (doc_id, notice_no, reason) notices (doc_id, notice_no, page, text, box) that cannot be placed."""
    box = lambda i: F.get("box", F.lit(i))
    reason = (
        F.when(T.strip(F.coalesce("text", F.lit(""))) == "", "text")
        .when(F.col("page").isNull() | (F.col("page") < 0) | (F.col("page") >= F.col("n_pages")), "page")
        .when(F.coalesce(F.size("box"), F.lit(0)) != 4, "box")
        .when(F.coalesce((box(2) <= box(0)) | (box(3) <= box(1)), F.lit(True)), "empty-box")
    )
    return notices.join(page_counts.select("doc_id", "n_pages"), "doc_id", "left").select("doc_id", "notice_no", reason.alias("reason")).filter("reason is not null")


def united_lists(mappings: DataFrame, columns: list[str]) -> DataFrame:
    """SET-1: the sorted union of each list column (one row): distinct members meet in a partial aggregate."""
    one = mappings.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("members")) for c in columns))).alias("l"))
    members = one.select("l.name", F.explode("l.members").alias("member")).distinct()
    return members.groupBy("name").agg(F.sort_array(F.collect_list("member")).alias("members"))


def concatenated(mappings: DataFrame, columns: list[str], order: str = "ord") -> DataFrame:
    """SET-2: (name, ord, place, member) the members of list columns of several mappings one after the other, repeats
    kept: by the mapping's place, then their own."""
    one = mappings.select(F.col(order).alias("ord"), F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("members")) for c in columns))).alias("l"))
    return one.select("l.name", "ord", F.posexplode("l.members").alias("place", "member"))


def folded_proposals(merges: DataFrame, proposals: DataFrame) -> DataFrame:
    """SET-6: merges plus the proposals whose lines no merge of the document has yet; of equal proposals the first."""
    new = proposals.join(merges.select("doc_id", "lines"), ["doc_id", "lines"], "left_anti")
    first = new.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", "lines").orderBy("warning_no"))).filter("_r = 1")
    columns = ["doc_id", "page", "lines", "html", "align"]
    return merges.select(columns).unionByName(first.select(columns))


def distinct_in_order(rows: DataFrame, columns: list[str], order: str = "ord") -> DataFrame:
    """AGG-19: distinct rows with the place of their first occurrence."""
    return rows.groupBy(*columns).agg(F.min(order).alias(order))


def role_requests(asks: DataFrame) -> DataFrame:
    """AGG-18: (role, n, keys) how often a font role that is not configured was asked for, and by which keys."""
    return asks.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("key")).alias("keys"))


def glyph_counts(glyphs: DataFrame) -> DataFrame:
    """AGG-13: (probe, arm, n_glyphs, fonts) of traced glyph spans (probe, arm, font, chars array)."""
    return glyphs.groupBy("probe", "arm").agg(F.sum(F.size("chars")).alias("n_glyphs"), F.sort_array(F.collect_set("font")).alias("fonts"))


def corpus_summary(files: DataFrame) -> DataFrame:
    """AGG-17: (verdict, n_files, n_pages, n_segments) of files (verdict, pages, segments), all together last."""
    return files.rollup("verdict").agg(F.count(F.lit(1)).alias("n_files"), F.sum("pages").alias("n_pages"), F.sum("segments").alias("n_segments"))


def retargeted_metadata(documents: DataFrame, mapping: DataFrame, lang: str) -> DataFrame:
    """PLC-7: document strings (doc_id, title, outline) with authored targets and the new language; what is not
    authored stays. The outline is exploded, joined and put together again in order."""
    named = mapping.filter("target is not null and target <> ''").select("core", "target")
    title = documents.join(named, F.trim("title") == F.col("core"), "left").select("doc_id", F.coalesce("target", "title").alias("title"))
    marks = documents.select("doc_id", F.posexplode_outer("outline").alias("at", "mark")).join(named, F.col("mark") == F.col("core"), "left")
    outline = marks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", F.coalesce("target", "mark").alias("m"))))).alias("o"))
    return title.join(outline.select("doc_id", F.col("o.m").alias("outline")), "doc_id").withColumn("lang", F.lit(lang))


def plain_violations(targets: DataFrame) -> DataFrame:
    """SCR-15: (occurrence_id) targets (occurrence_id, text) with controls, format characters or private use."""
    return targets.filter(~S.is_plain_text(F.col("text"))).select("occurrence_id")


def missing_glyphs(targets: DataFrame, repertoire: DataFrame) -> DataFrame:
    """SCR-16: (font, char, n_targets) visible characters of targets (font, text) that their font (font, char) lacks."""
    needed = targets.select("font", F.explode(S.characters(F.col("text"))).alias("char")).filter("char <> ''").filter(~F.col("char").rlike(r"^[\p{Cc}\p{Cf}]$"))
    return needed.groupBy("font", "char").agg(F.count(F.lit(1)).alias("n_targets")).join(repertoire.select("font", "char"), ["font", "char"], "left_anti")
