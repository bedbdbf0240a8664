"""From text to segments: lines, gap groups, parsed parts, dictionaries and layout warnings.

A segment has doc_id, page, id, its box x0 y0 x1 y1, its origin ox oy, size, text, core and passthrough.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import constants as K
from scriptorium.functions import text as T


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, text): every line of every document; a null text has none."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


def gap_groups(spans: DataFrame, gap: float = K.GROUP_GAP) -> DataFrame:
    """PRJ-1: spans (doc_id, page, line_no, span_no, x0, y0, x1, y1, text, bold, italic) of a line split where the
    distance to everything before is at least ``gap``; one row a group with text, union box and styles.

    The split is an interval merge: a span opens a group if it starts ``gap`` right of the largest right edge so far.
    """
    line = Window.partitionBy("doc_id", "page", "line_no").orderBy("span_no")
    before = F.max("x1").over(line.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("x0") - before >= gap), 1).otherwise(0)
    grouped = spans.withColumn("_opens", opens).withColumn("group_no", F.sum("_opens").over(line))
    return grouped.groupBy("doc_id", "page", "line_no", "group_no").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("span_no", "text"))), lambda s: s["text"]), "").alias("text"),
        *(F.min(c).alias(c) for c in ("x0", "y0")),
        *(F.max(c).alias(c) for c in ("x1", "y1")),
        F.bool_or("bold").alias("bold"),
        F.bool_or("italic").alias("italic"),
    )


def with_parts(segments: DataFrame) -> DataFrame:
    """PRJ-2 to PRJ-5: marker, gap, core, dots, tail, passthrough and inner_gap of each segment's text."""
    lead = T.leader_parts(T.without_marker(F.col("text")))
    out = segments.withColumn("marker", T.marker(F.col("text"))).withColumn("_lead", lead)
    return out.select(
        *segments.columns,
        "marker",
        F.when(F.col("marker") != "", T.marker_gap(F.ltrim("text"))).otherwise("").alias("gap"),
        *(F.col(f"_lead.{c}").alias(c) for c in ("core", "dots", "tail")),
        T.is_passthrough(F.col("_lead.core")).alias("passthrough"),
        T.has_inner_gap(F.col("text")).alias("inner_gap"),
    )


def cores(segments: DataFrame, document_strings: DataFrame | None = None) -> DataFrame:
    """AGG-1: (text, count) of the distinct cores that need translating, plus titles and outline entries (doc_id, text)."""
    found = segments.filter(~F.col("passthrough")).select(F.col("core").alias("text"))
    if document_strings is not None:
        found = found.unionByName(document_strings.select("text").filter("text is not null and text <> ''"))
    return found.groupBy("text").agg(F.count(F.lit(1)).alias("count"))


def write_find_say_rows(lines: DataFrame) -> DataFrame:
    """PRJ-6: (doc_id, line_no, kind, snippet) of what may have to stay verbatim."""
    return lines.select("doc_id", "line_no", F.explode(T.write_find_say(F.col("text"))).alias("hit")).select("doc_id", "line_no", "hit.kind", "hit.snippet")


def merge_candidates(segments: DataFrame) -> DataFrame:
    """WIN-1: islands of two or more lines that stand in one column, follow closely, and don't end a sentence before
    the last; (doc_id, page, ids, lines). Only the previous line decides, so one ordered window finds the breaks."""
    page = Window.partitionBy("doc_id", "page").orderBy("oy", "ox", "id")
    lag = lambda c: F.lag(c).over(page)
    step = F.col("oy") - lag("oy")
    joins = (
        (F.abs(F.col("ox") - lag("ox")) < K.MERGE_COLUMN)
        & (step > K.MERGE_MIN_STEP)
        & (step < F.greatest(F.col("size"), lag("size")) * K.MERGE_MAX_STEP)
        & ~F.rtrim(lag("core")).rlike(K.OPEN_END)
    )
    marked = segments.filter(~F.col("passthrough")).withColumn("_break", F.when(joins, 0).otherwise(1))
    islands = marked.withColumn("_island", F.sum("_break").over(page))
    gathered = islands.groupBy("doc_id", "page", "_island").agg(F.sort_array(F.collect_list(F.struct("oy", "ox", "id", F.trim("text").alias("line")))).alias("m"))
    return gathered.filter(F.size("m") >= 2).select("doc_id", "page", F.col("m.id").alias("ids"), F.col("m.line").alias("lines"))


def narrow_columns(segments: DataFrame) -> DataFrame:
    """WIN-2: stacks of three or more narrow segments whose left edges are near the stack's first one's;
    (doc_id, page, ids, width, lines). The first of the run decides, so a page's rows are folded in order."""
    narrow = segments.filter(~F.col("passthrough") & (F.col("x1") - F.col("x0") < K.NARROW_WIDTH))
    row = F.struct("x0", "oy", "id", "size", (F.col("x1") - F.col("x0")).alias("width"), "core")
    pages = narrow.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    kind = "array<struct<x0:double,oy:double,id:int,size:double,width:double,core:string>>"
    first = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.array().cast(kind).alias("run"))

    def step(acc: Column, s: Column) -> Column:
        run = acc["run"]
        last, head = F.element_at(run, -1), F.get(run, F.lit(0))
        down = s["oy"] - last["oy"]
        joins = (F.size(run) > 0) & (F.abs(s["x0"] - head["x0"]) < K.MERGE_COLUMN) & (down > K.MERGE_MIN_STEP) & (down < F.greatest(last["size"], s["size"]) * K.MERGE_MAX_STEP)
        longer = F.struct(acc["done"].alias("done"), F.concat(run, F.array(s)).alias("run"))
        anew = F.struct(F.when(F.size(run) >= K.NARROW_RUN, F.concat(acc["done"], F.array(run))).otherwise(acc["done"]).alias("done"), F.array(s).alias("run"))
        return F.when(F.size(run) == 0, longer).when(joins, longer).otherwise(anew)

    last_too = lambda acc: F.when(F.size(acc["run"]) >= K.NARROW_RUN, F.concat(acc["done"], F.array(acc["run"]))).otherwise(acc["done"])
    typed = F.col("rows").cast(kind)
    runs = pages.select("doc_id", "page", F.explode(F.aggregate(typed, first, step, last_too)).alias("run"))
    return runs.select("doc_id", "page", F.col("run.id").alias("ids"), F.bround(F.array_max("run.width"), 2).alias("width"), F.col("run.core").alias("lines"))


def tucked(segments: DataFrame, verticals: DataFrame) -> DataFrame:
    """Segments with a vertical (doc_id, page, x, top, bottom) within one em right of their edge, over their row.

    A range join made equal by cells: edges are filed in cells of 64 points, a segment looks into the cells that its
    reach covers, and the exact test follows.
    """
    cell = 64.0
    reach = F.col("x1") + F.coalesce(F.col("size"), F.lit(10.0)) * K.TUCK_EM
    height = F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))
    looking = segments.withColumn("_cell", F.explode(F.sequence(F.floor((F.col("x1") - 1) / cell), F.floor(reach / cell)))).withColumn("_reach", reach).withColumn("_h", height)
    filed = verticals.select(F.col("doc_id").alias("v_doc"), F.col("page").alias("v_page"), "x", "top", "bottom", F.floor(F.col("x") / cell).alias("v_cell"))
    near = (
        (F.col("doc_id") == F.col("v_doc"))
        & (F.col("page") == F.col("v_page"))
        & (F.col("_cell") == F.col("v_cell"))
        & (F.col("x") >= F.col("x1") - 1.0)
        & (F.col("x") <= F.col("_reach"))
        & (F.col("bottom") >= F.col("y0") + K.TUCK_ROW_OVERLAP * F.col("_h"))
        & (F.col("top") <= F.col("y1") - K.TUCK_ROW_OVERLAP * F.col("_h"))
    )
    return looking.join(filed, near, "left_semi").select(segments.columns).distinct()


def right_aligned(segments: DataFrame, verticals: DataFrame | None = None) -> DataFrame:
    """WIN-3: groups that share a right edge, have spread left edges, and half of which sit against something;
    (doc_id, page, ids, right_edge). Every segment's left edge counts as a vertical."""
    own = segments.select("doc_id", "page", F.col("x0").alias("x"), F.col("y0").alias("top"), F.col("y1").alias("bottom"))
    edges = own if verticals is None else own.unionByName(verticals.select(own.columns))
    shown = segments.filter(~F.col("passthrough"))
    flagged = shown.join(tucked(shown, edges).select("doc_id", "page", "id").withColumn("_tucked", F.lit(1)), ["doc_id", "page", "id"], "left")
    bucket = F.bround(F.col("x1") / K.RIGHT_EDGE_TOLERANCE)
    groups = flagged.groupBy("doc_id", "page", bucket.alias("_edge")).agg(
        F.count(F.lit(1)).alias("n"),
        (F.max("x0") - F.min("x0")).alias("spread"),
        F.count("_tucked").alias("n_tucked"),
        F.sort_array(F.collect_list("id")).alias("ids"),
        F.bround(F.max("x1"), 2).alias("right_edge"),
    )
    enough = F.col("n_tucked") >= F.greatest(F.lit(1), F.floor((F.col("n") + 1) / 2))
    return groups.filter((F.col("n") >= 2) & (F.col("spread") > K.RIGHT_LEFT_SPREAD) & enough).select("doc_id", "page", "ids", "right_edge")


def warning_digest(warnings: DataFrame, known: tuple[str, ...] = ()) -> DataFrame:
    """AGG-2: (kind, count), the known kinds first and in their order, then the others by name."""
    rank = F.coalesce(*(F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(known)), F.lit(len(known))) if known else F.lit(0)
    return warnings.groupBy("kind").agg(F.count(F.lit(1)).alias("count")).orderBy(rank, "kind")


def first_of_each(rows: DataFrame, by: list[str], order: list[str | Column], k: int = 1, group: str = "n_in_group") -> DataFrame:
    """WIN-11: the first ``k`` rows of each group, with the group's size and how many are not shown."""
    w = Window.partitionBy(*by)
    numbered = rows.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn(group, F.count(F.lit(1)).over(w))
    return numbered.filter(F.col("rank") <= k).withColumn("not_shown", F.greatest(F.col(group) - k, F.lit(0)))


def document_only(strings: DataFrame, segments: DataFrame, strip: Callable[[Column], Column] = T.strip) -> DataFrame:
    """SET-5: (doc_id, text) titles and outline entries that are on no page of their document; ``strip`` makes a string
    what a core is, without the spaces at its ends."""
    return strings.select("doc_id", strip(F.col("text")).alias("text")).filter("text <> ''").distinct().join(segments.select("doc_id", F.col("core").alias("text")), ["doc_id", "text"], "left_anti")


def image_regions(images: DataFrame, least_area: float = 400.0) -> DataFrame:
    """SRC-13: images (doc_id, page, x0, y0, x1, y1) large enough to hold text."""
    return images.filter((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= least_area)


def page_obstacles(widgets: DataFrame, strokes: DataFrame, rects: DataFrame) -> DataFrame:
    """SRC-12: verticals (doc_id, page, x, top, bottom): left edges of widgets, upright strokes, sides of tall rectangles."""
    ends = lambda lo, hi: [F.least(lo, hi).alias("top"), F.greatest(lo, hi).alias("bottom")]
    w = widgets.select("doc_id", "page", F.col("x0").alias("x"), F.col("y0").alias("top"), F.col("y1").alias("bottom"))
    upright = (F.abs(F.col("x0") - F.col("x1")) < 1.5) & (F.abs(F.col("y0") - F.col("y1")) > 4)
    s = strokes.filter(upright).select("doc_id", "page", F.col("x0").alias("x"), *ends(F.col("y0"), F.col("y1")))
    r = rects.filter(F.col("y1") - F.col("y0") > 4).select("doc_id", "page", F.explode(F.array("x0", "x1")).alias("x"), F.col("y0").alias("top"), F.col("y1").alias("bottom"))
    return w.unionByName(s).unionByName(r)


def source_runs(spans: DataFrame) -> DataFrame:
    """PRJ-12: spans (segment keys, span_no, text, font, candidates) with their offsets [start, end) in the segment's text
    and the font they resolve to: exactly one candidate, else null with the reason."""
    order = Window.partitionBy("doc_id", "id").orderBy("span_no")
    end = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reason = F.when(F.size("candidates") == 0, "missing-font").when(F.size("candidates") > 1, "ambiguous-font")
    return spans.withColumn("start", end - F.length("text")).withColumn("end", end).withColumn("font_id", F.when(F.size("candidates") == 1, F.get("candidates", F.lit(0)))).withColumn("unresolved", reason)


def merge_boxes(members: DataFrame) -> DataFrame:
    """AGG-9: members (merge_id, x0, y0, x1, y1, oy, size) of each merge as one box, size, and leading: the average
    distance of baselines over half a point, in sizes, to three places."""
    gap = F.col("oy") - F.lag("oy").over(Window.partitionBy("merge_id").orderBy("oy"))
    measured = members.withColumn("_gap", F.when(gap > 0.5, gap))
    out = measured.groupBy("merge_id").agg(*(F.min(c).alias(c) for c in ("x0", "y0")), *(F.max(c).alias(c) for c in ("x1", "y1")), F.max("size").alias("size"), F.avg("_gap").alias("_step"))
    return out.withColumn("leading", F.coalesce(F.bround(F.col("_step") / F.col("size"), 3), F.lit(K.DEFAULT_LEADING))).drop("_step")


def merge_proposals(warnings: DataFrame, segments: DataFrame, least: int = 2) -> DataFrame:
    """MAP-3: candidate warnings (doc_id, warning_no, kind, page, ids) as editable merges with the lines' texts in order."""
    fitting = warnings.filter(F.col("kind").isNull() | F.col("kind").isin("merge-candidate", "narrow-column")).filter(F.size("ids") >= least)
    lines = segments.select(F.col("doc_id").alias("s_doc"), F.col("id").alias("s_id"), F.trim("text").alias("line")).distinct()
    members = fitting.select("doc_id", "warning_no", "page", F.posexplode("ids").alias("at", "id")).join(lines, F.expr("doc_id <=> s_doc and id = s_id"))
    gathered = members.groupBy("doc_id", "warning_no", "page").agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("m"))
    return gathered.filter(F.size("m") >= least).select("doc_id", "warning_no", "page", F.col("m.line").alias("lines"), F.lit(None).cast("string").alias("html"), F.lit("left").alias("align"))
