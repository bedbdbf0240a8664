"""The verification report: one row a gate and document, from the operators that find problems.

Inputs are a dictionary of DataFrames by name; a gate whose inputs are absent has no row, which is not a pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import constants as K
from scriptorium.functions import scripts as S
from scriptorium.operators import layout, leaks, parity, raster
from scriptorium.operators.parity import gate


def _rows(name: str, statuses: DataFrame) -> DataFrame:
    """Gate rows from (doc_id, status, n_findings)."""
    return statuses.select("doc_id", F.lit(name).alias("gate"), F.lit(K.GATES.index(name)).alias("ord"), "status", F.col("n_findings").cast("long").alias("n_findings"))


def scaled_runs(reports: DataFrame) -> DataFrame:
    """SKIP without a report, PASS with an empty one, REVIEW with runs: (doc_id, runs)."""
    n = F.coalesce(F.size("runs"), F.lit(-1))
    status = F.when(F.col("runs").isNull(), "SKIP").when(n == 0, "PASS").otherwise("REVIEW")
    return _rows("scaled-runs", reports.select("doc_id", status.alias("status"), F.greatest(n, F.lit(0)).alias("n_findings")))


def fill_roundtrip(trials: DataFrame) -> DataFrame:
    """Trials (doc_id, n_fields, text_kept, box_kept; null where there is no such field): SKIP without fields."""
    lost = F.when(~F.coalesce("text_kept", F.lit(True)), 1).otherwise(0) + F.when(~F.coalesce("box_kept", F.lit(True)), 1).otherwise(0)
    status = F.when(F.col("n_fields") == 0, "SKIP").when(lost > 0, "FAIL").otherwise("PASS")
    return _rows("fill-roundtrip", trials.select("doc_id", status.alias("status"), lost.alias("n_findings")))


def ink_ratio(pages: DataFrame) -> DataFrame:
    """Page pairs (doc_id, page, ink_a, ink_b): FAIL if one page is out of bounds, SKIP if none has enough ink."""
    judged = pages.withColumn("s", raster.ink_status(F.col("ink_a"), F.col("ink_b"))).groupBy("doc_id").agg(F.count_if(F.col("s") == "FAIL").alias("n_findings"), F.count_if(F.col("s") != "SKIP").alias("n"))
    return _rows("ink-ratio", judged.select("doc_id", F.when(F.col("n") == 0, "SKIP").when(F.col("n_findings") > 0, "FAIL").otherwise("PASS").alias("status"), "n_findings"))


def measured(name: str, probes: DataFrame) -> DataFrame:
    """Gates over measured probes (doc_id, status): FAIL over REVIEW over PASS; documents without probes are silent."""
    rank = F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "REVIEW", 1).otherwise(0)
    worst = probes.groupBy("doc_id").agg(F.max(rank).alias("w"), F.count_if(F.col("status") != "PASS").alias("n_findings"))
    return _rows(name, worst.select("doc_id", F.when(F.col("w") == 2, "FAIL").when(F.col("w") == 1, "REVIEW").otherwise("PASS").alias("status"), "n_findings"))


def leak_scan(scans: DataFrame) -> DataFrame:
    """Where the leak scan can't run: (doc_id, source_script, output_script, by_tell). Source and output in the same
    script without spaces look alike to it: SKIP where the repertoire tell judged the document, else REVIEW. Other
    documents have no row, as the scan's own gates speak for them."""
    alike = (F.col("source_script") == F.col("output_script")) & F.col("source_script").isin(*K.SPACELESS_SCRIPTS)
    told = F.coalesce("by_tell", F.lit(False))
    rows = scans.filter(alike).select("doc_id", F.when(told, "SKIP").otherwise("REVIEW").alias("status"), F.when(told, 0).otherwise(1).alias("n_findings"))
    return _rows("leak-scan", rows)


def shaping(probes: DataFrame) -> DataFrame:
    """Probes of shaping (doc_id, codepoints, naive, shaped, naive_font, shaped_font, expected_font) judged and rolled up."""
    columns = ("codepoints", "naive", "shaped", "naive_font", "shaped_font", "expected_font")
    return measured("conjunct-shaping", probes.select("doc_id", raster.shaping_verdict(*(F.col(c) for c in columns)).alias("status")))


def han_forms(probes: DataFrame) -> DataFrame:
    """Probes of Han faces (doc_id, face, character, own, other): a face is judged by its mean glyph differences from
    its own and the other convention over all probed characters, a document by its worst face."""
    means = probes.groupBy("doc_id", "face").agg(F.avg("own").alias("own"), F.avg("other").alias("other"), F.count_distinct("character").alias("n"))
    return measured("han-forms", means.select("doc_id", raster.face_verdict(F.col("own"), F.col("other"), F.col("n")).alias("status")))


def leak_cjk(lines: DataFrame, source: str, target: str, allow: list[str] | None = None) -> DataFrame:
    """Lines (doc_id, line_no, text) judged by the repertoire tell; documents with Han or kana lines and no tell pass."""
    told = leaks.tell_lines(lines, source, target, allow).select("doc_id", "status")
    clean = lines.filter(S.has_cjk(F.col("text"))).select("doc_id", F.lit("PASS").alias("status")).distinct()
    return measured("leak-cjk", told.unionByName(clean))


def report(inputs: dict[str, DataFrame], lang: str | None = None, allowed_prefix: str | None = None, conventions: tuple[str, str] | None = None) -> DataFrame:
    """All gates that the inputs allow: (doc_id, gate, ord, status, n_findings).

    Names of inputs: documents (doc_id); fields, fields_out; options, options_out; widgets, widgets_out,
    widget_mapping; pages, pages_out; trials; ink_pages; blank_pages; visible_pages; text (doc_id, text); authored
    (doc_id, text); page_text (doc_id, page, text); lines (of pages, with boxes); runs (doc_id, run, bucket); tells;
    mapping (core, target); targets (doc_id, target); actual_text; captions, captions_out; wide_captions; overrides,
    segments; strings, strings_out; scale; spans (doc_id, kind, snippet); scans (see leak_scan). Measured probes are
    judged here: shaping and faces (see shaping, han_forms), and cjk_lines between ``conventions`` (source, target);
    where they come with a status of their own (doc_id, status), as tells and typography do, that is rolled up.
    """
    docs, has = inputs["documents"], inputs.keys().__contains__
    rows: list[DataFrame] = []
    add = rows.append
    if has("fields"):
        add(gate("field-parity", parity.field_parity(inputs["fields"], inputs["fields_out"], allowed_prefix), docs))
    if has("options"):
        judged = inputs["options"].select("doc_id").unionByName(inputs["options_out"].select("doc_id"))
        add(gate("opt-export-parity", parity.option_parity(inputs["options"], inputs["options_out"]), judged))
    if has("widgets"):
        add(gate("widget-text", parity.widget_text_left(inputs["widgets"], inputs["widgets_out"], inputs.get("widget_mapping")), inputs["widgets"], bad="REVIEW"))
    if has("trials"):
        add(fill_roundtrip(inputs["trials"]))
    if has("pages"):
        add(gate("page-parity", parity.page_parity(inputs["pages"], inputs["pages_out"]), docs))
    if has("blank_pages"):
        add(gate("extractable-text", raster.unextractable(inputs["blank_pages"]), docs, none=None))
    if has("ink_pages"):
        add(ink_ratio(inputs["ink_pages"]))
    if has("visible_pages"):
        add(gate("visible-text", raster.invisible_pages(inputs["visible_pages"]), inputs["visible_pages"]))
    if has("authored"):
        add(gate("canonical-text", leaks.drifted_characters(inputs["text"], inputs["authored"]), docs))
    if has("page_text"):
        found = leaks.arabic_judged(inputs["page_text"])
        add(gate("arabic-letterforms", leaks.unshaped_arabic(inputs["page_text"]), found))
    if has("shaping"):
        probes = inputs["shaping"]
        add(measured("conjunct-shaping", probes) if "status" in probes.columns else shaping(probes))
    if has("lines"):
        stacked = layout.stacks(inputs["lines"])
        add(gate("kinsoku", layout.kinsoku(stacked), layout.judged_documents(stacked), bad="REVIEW"))
    if has("faces"):
        probes = inputs["faces"]
        add(measured("han-forms", probes) if "status" in probes.columns else han_forms(probes))
    if has("scans"):
        add(leak_scan(inputs["scans"]))
    if has("cjk_lines") and conventions:
        add(leak_cjk(inputs["cjk_lines"], *conventions))
    if has("tells"):
        add(measured("leak-cjk", inputs["tells"]))
    if has("runs"):
        add(gate("leak-running", inputs["runs"].filter("bucket = 'running'"), docs))
        add(gate("leak-isolated", inputs["runs"].filter("bucket = 'isolated'"), docs, bad="REVIEW"))
    if has("mapping"):
        empty = parity.empty_targets(inputs["mapping"])
        if "doc_id" in empty.columns:
            add(gate("empty-targets", empty, docs))
        else:  # one mapping for all documents: each of them has its empty targets
            n = empty.count()
            add(_rows("empty-targets", docs.select("doc_id").distinct().withColumns({"status": F.lit("FAIL" if n else "PASS"), "n_findings": F.lit(n)})))
    if has("targets"):
        add(gate("placement", parity.missing_targets(inputs["text"], inputs["targets"]), docs))
        if has("actual_text"):
            add(gate("shaped-actualtext", parity.unmarked_shaped(inputs["actual_text"], inputs["targets"]), docs))
    if has("captions"):
        add(gate("button-captions", parity.leftover_captions(inputs["captions"], inputs["captions_out"], inputs["text"]), docs))
    if has("wide_captions"):
        add(gate("caption-width", inputs["wide_captions"], docs))
    if has("overrides"):
        with_overrides = inputs["overrides"].select("doc_id").distinct()
        add(gate("override-markers", parity.override_misses(inputs["segments"], inputs["overrides"]), docs.join(with_overrides, "doc_id", "left_semi")))
        without = docs.select("doc_id").distinct().join(with_overrides, "doc_id", "left_anti")
        add(_rows("override-markers", without.withColumns({"status": F.lit("SKIP"), "n_findings": F.lit(0)})))
    if has("strings"):
        add(gate("metadata", parity.metadata_misses(inputs["strings"], inputs["strings_out"], inputs["mapping"], lang), docs))
        if not lang:
            add(gate("metadata-lang", docs, docs, bad="REVIEW"))
    if has("scale"):
        add(scaled_runs(inputs["scale"]))
    if has("spans"):
        add(gate("identifiers", parity.missing_identifiers(inputs["text"], inputs["spans"]), docs))
    if has("typography"):
        add(measured("typography", inputs["typography"]))
    return reduce(DataFrame.unionByName, rows) if rows else docs.limit(0).select("doc_id", F.lit("").alias("gate"), F.lit(0).alias("ord"), F.lit("").alias("status"), F.lit(0).cast("long").alias("n_findings"))
