"""Whether an output still has what its original had: pages, fields, options, authored strings, identifiers, captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import constants as K
from scriptorium.functions import scripts as S
from scriptorium.functions import text as T


def field_parity(original: DataFrame, output: DataFrame, allowed_prefix: str | None = None) -> DataFrame:
    """JOIN-8: fields (doc_id, name, type) missing, of another type, or extra in the output: (doc_id, name, problem)."""
    a, b = original.select("doc_id", "name", F.col("type").alias("type_a")), output.select("doc_id", "name", F.col("type").alias("type_b"))
    problem = F.when(F.col("type_b").isNull(), "missing").when(F.col("type_a").isNull(), "extra").when(F.col("type_a") != F.col("type_b"), "type-mismatch")
    found = a.join(b, ["doc_id", "name"], "full_outer").withColumn("problem", problem).filter("problem is not null")
    if allowed_prefix:
        found = found.filter((F.col("problem") != "extra") | ~F.col("name").startswith(allowed_prefix))
    return found.select("doc_id", "name", "problem")


def option_parity(original: DataFrame, output: DataFrame) -> DataFrame:
    """JOIN-10: choice fields (doc_id, name, exports array) whose ordered exports differ or that one side lacks."""
    a, b = original.select("doc_id", "name", F.col("exports").alias("a")), output.select("doc_id", "name", F.col("exports").alias("b"))
    return a.join(b, ["doc_id", "name"], "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("doc_id", "name", F.coalesce(F.size("a"), F.lit(-1)).alias("n_original"), F.coalesce(F.size("b"), F.lit(-1)).alias("n_output"))


def _box_differs(a: str, b: str) -> Column:
    def side(i: int) -> Column:
        x, y = F.get(a, F.lit(i)), F.get(b, F.lit(i))
        return F.abs(x - y) > F.lit(K.PAGE_BOX_TOLERANCE) + F.lit(2.4e-7) * F.greatest(F.lit(1.0), F.abs(x), F.abs(y))

    return side(0) | side(1) | side(2) | side(3)


def page_parity(original: DataFrame, output: DataFrame) -> DataFrame:
    """JOIN-9: pages (doc_id, page, media_box, crop_box, rotation) missing, extra or changed: (doc_id, page, problem)."""
    named = lambda df, s: df.select("doc_id", "page", *(F.col(c).alias(f"{c}_{s}") for c in ("media_box", "crop_box", "rotation")))
    both = named(original, "a").join(named(output, "b"), ["doc_id", "page"], "full_outer")
    here = F.col("rotation_a").isNotNull() & F.col("rotation_b").isNotNull()
    problems = F.array(
        F.when(F.col("rotation_b").isNull(), F.lit("missing")),
        F.when(F.col("rotation_a").isNull(), F.lit("extra")),
        F.when(here & _box_differs("media_box_a", "media_box_b"), F.lit("media-box")),
        F.when(here & _box_differs("crop_box_a", "crop_box_b"), F.lit("crop-box")),
        F.when(here & (F.col("rotation_a") != F.col("rotation_b")), F.lit("rotation")),
    )
    return both.select("doc_id", "page", F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem"))


def widget_text_left(before: DataFrame, after: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """JOIN-11: widget strings (doc_id, field, slot, export, text) that the output still shows in the source language.

    Equal strings with a letter count, unless the mapping (doc_id, field, slot, export, source, target) kept them on
    purpose: a field it does not name, a slot it leaves out, or a target equal to its source. A null target is no
    decision.
    """
    keys = ["doc_id", "field", "slot", "export"]
    same = before.alias("b").join(after.alias("a"), [F.col(f"b.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys]).filter("b.text = a.text").select("b.*")
    left = same.filter(F.col("text").rlike(r"\p{L}"))
    if mapping is None:
        return left
    decided = mapping.filter("target is null or target <> source").select(*keys)
    return left.alias("l").join(decided.alias("m"), [F.col(f"l.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys], "left_semi")


def translated_segments(segments: DataFrame, mapping: DataFrame, overridden: DataFrame | None = None, skip: DataFrame | None = None) -> DataFrame:
    """JOIN-1: segments with their target and state: passthrough, skipped, overridden, translated or missing."""
    named = mapping.select("core", "target").dropDuplicates(["core"])
    out = segments.join(named, "core", "left")
    out = out.join(overridden.select(F.col("doc_id").alias("_o_doc"), F.col("id").alias("_o_id")).distinct().withColumn("_o", F.lit(True)), F.expr("doc_id <=> _o_doc and id = _o_id"), "left").drop("_o_doc", "_o_id") if overridden is not None else out.withColumn("_o", F.lit(None).cast("boolean"))
    out = out.join(skip.select("core").distinct().withColumn("_s", F.lit(True)), "core", "left") if skip is not None else out.withColumn("_s", F.lit(None).cast("boolean"))
    state = F.when(F.col("passthrough"), "passthrough").when(F.col("_s"), "skipped").when(F.col("_o"), "overridden").when(F.col("target").isNotNull(), "translated").otherwise("missing")
    return out.withColumn("state", state).drop("_o", "_s")


def untranslated(segments: DataFrame, mapping: DataFrame) -> DataFrame:
    """JOIN-2: (doc_id, id, core) segments that need a target and have none: the mapping refuses to build."""
    return segments.filter(~F.col("passthrough")).join(mapping.filter("target is not null").select("core"), "core", "left_anti").select("doc_id", "id", "core")


def override_matches(segments: DataFrame, overrides: DataFrame) -> DataFrame:
    """JOIN-3: (doc_id, id, override_no) the first override of the page whose text the segment contains."""
    named = overrides.select(F.col("doc_id").alias("o_doc"), F.col("page").alias("o_page"), "override_no", F.col("contains").alias("o_text"))
    hit = (F.col("doc_id") == F.col("o_doc")) & (F.col("page") == F.col("o_page")) & F.contains(F.col("text"), F.col("o_text"))
    return segments.join(named, hit).groupBy("doc_id", "id").agg(F.min("override_no").alias("override_no"))


def override_misses(segments: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides (doc_id, override_no) that no segment of their page contains."""
    used = segments.alias("s").join(overrides.alias("o"), (F.col("s.doc_id") == F.col("o.doc_id")) & (F.col("s.page") == F.col("o.page")) & F.contains(F.col("s.text"), F.col("o.contains"))).select("o.doc_id", "o.override_no").distinct()
    return overrides.select("doc_id", "override_no").join(used, ["doc_id", "override_no"], "left_anti")


def missing_targets(page_text: DataFrame, targets: DataFrame) -> DataFrame:
    """JOIN-5: (doc_id, target) authored strings of two characters or more that their document's text lacks.

    White space is collapsed on both sides; in spaceless scripts it is removed, as lines break without a space there.
    """
    text = page_text.select(F.col("doc_id").alias("t_doc"), T.normalize_ws(F.col("text")).alias("hay"), F.regexp_replace("text", K.WRAP_SPACE, "").alias("joined"))
    wanted = targets.select("doc_id", "target", T.normalize_ws(F.col("target")).alias("n")).filter(F.length("n") >= 2).dropDuplicates(["doc_id", "n"])
    joined = F.contains(F.col("joined"), F.regexp_replace("target", K.WRAP_SPACE, ""))
    there = F.contains(F.col("hay"), F.col("n")) | (S.has_spaceless_script(F.col("n")) & joined)
    return wanted.join(text, (F.col("doc_id") == F.col("t_doc")) & there, "left_anti").select("doc_id", "target")


#: Up to so many phrases their keys, sixteen bytes each, are broadcast to the texts.
BROADCAST_KEYS = 500_000


def occurrences(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """Which phrases (item_id, text) stand verbatim in which texts (doc_id, text): (item_id, doc_id).

    A phrase may start and end inside a word of the text, after a bracket or before a comma, but the words between its
    first and last are whole there: phrases and texts meet on up to eight of these, hashed. A phrase of one or two
    words has none and meets the texts on its first eight characters, or as many as it has. The whole containment is
    tested then, so every phrase is found wherever it stands.
    """
    words = lambda c: F.split(F.btrim(F.regexp_replace(c, r"\s+", " ")), " ")
    chars = lambda c: F.split(c, "")
    listed = phrases.filter("text is not null").select("item_id", F.col("text").alias("phrase"), words(F.col("text")).alias("w"))
    inner = listed.filter(F.size("w") > 2).select("item_id", F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0))).alias("parts"), F.lit(" ").alias("by"))
    brief = listed.filter(F.size("w") <= 2).select("item_id", F.when(F.col("phrase") == "", F.array().cast("array<string>")).otherwise(chars(F.col("phrase"))).alias("parts"), F.lit("").alias("by"))
    cut = inner.unionByName(brief).withColumn("n", F.least(F.lit(8), F.size("parts")))
    hashed = cut.withColumn("h", F.transform(F.slice("parts", 1, F.col("n")), lambda x: F.xxhash64(x)))
    by_size = [F.when(F.col("n") == n, F.xxhash64("by", "n", *(F.get("h", F.lit(k)) for k in range(n)))) for n in range(9)]
    keyed = hashed.select("item_id", "by", "n", F.coalesce(*by_size).alias("key"))
    sizes = sorted((r["by"], r["n"]) for r in keyed.select("by", "n").distinct().collect())  # at most 17 pairs
    if not sizes:
        return phrases.select("item_id", F.lit(None).cast(texts.schema["doc_id"].dataType).alias("doc_id")).filter(F.lit(False))
    starts = texts.filter("text is not null").select("doc_id", words(F.col("text")).alias("w"), chars(F.col("text")).alias("c"))

    def grams_of(by: str, n: int) -> Column:
        parts = F.transform(F.col("w" if by else "c"), lambda x: F.xxhash64(x))  # each part is hashed once
        places = lambda h: F.sequence(F.lit(0), F.greatest(F.size(h) - n, F.lit(0))) if n else F.array(F.lit(0))
        windows = lambda h: F.transform(places(h), lambda i: F.xxhash64(F.lit(by), F.lit(n), *(F.get(h, i + k) for k in range(n))))
        return F.get(F.transform(F.array(parts), windows), F.lit(0))

    grams = F.flatten(F.array(*(grams_of(by, n) for by, n in sizes)))
    pieces = starts.select("doc_id", F.explode(F.array_distinct(grams)).alias("key"))
    keys = keyed.select("key", "item_id")
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS  # then nothing but what met a key is shuffled
    met = pieces.join(F.broadcast(keys) if few else keys, "key").select("doc_id", "item_id").distinct()
    return met.join(texts.select("doc_id", "text"), "doc_id").join(listed.select("item_id", "phrase"), "item_id").filter(F.contains(F.col("text"), F.col("phrase"))).select("item_id", "doc_id").distinct()


def missing_identifiers(page_text: DataFrame, spans: DataFrame, allow: DataFrame | None = None) -> DataFrame:
    """JOIN-6: (doc_id, snippet) quoted strings and form names of the original that the output's text lacks."""
    hay = page_text.select(F.col("doc_id").alias("t_doc"), T.fold_drift(F.col("text")).alias("hay"))
    wanted = spans.filter(F.col("kind").isin("quoted", "form-name")).select("doc_id", "snippet", T.fold_drift(F.col("snippet")).alias("n")).filter(F.length("n") >= 2).dropDuplicates(["doc_id", "n"])
    if allow is not None:
        wanted = wanted.join(allow.select(T.fold_drift(F.col("snippet")).alias("n")).distinct(), "n", "left_anti")
    return wanted.join(hay, (F.col("doc_id") == F.col("t_doc")) & F.contains(F.col("hay"), F.col("n")), "left_anti").select("doc_id", "snippet")


def unmarked_shaped(actual_text: DataFrame, targets: DataFrame) -> DataFrame:
    """JOIN-7: (doc_id, target) targets that need shaping and that no logical-text span of their document carries."""
    hay = actual_text.groupBy(F.col("doc_id").alias("t_doc")).agg(F.array_join(F.collect_list("text"), "\n").alias("hay"))
    wanted = targets.select("doc_id", "target", T.normalize_ws(F.col("target")).alias("n")).filter((F.length("n") >= 2) & S.needs_shaping(F.col("n"))).dropDuplicates(["doc_id", "n"])
    return wanted.join(hay, (F.col("doc_id") == F.col("t_doc")) & F.contains(F.col("hay"), F.col("n")), "left_anti").select("doc_id", "target")


def leftover_captions(original: DataFrame, output: DataFrame, page_text: DataFrame, skip: list[str] | None = None) -> DataFrame:
    """(doc_id, name, caption) pushbutton captions of the original that the output neither rewrote nor hid.

    Buttons have doc_id, name, caption, flags (bit 16: pushbutton), annotation_flags (bit 1: hidden).
    """
    button = F.col("flags").bitwiseAND(K.PUSHBUTTON_BIT) != 0
    shown = original.filter(button & (F.trim("caption") != "")).select("doc_id", "name", F.trim("caption").alias("caption"), T.fold_drift(F.trim("caption")).alias("n"))
    shown = shown.filter(F.length("n") >= 2).filter(~F.col("caption").isin(*(skip or [""])))
    now = output.filter(button).select("doc_id", "name", T.fold_drift(F.trim("caption")).alias("now"), (F.col("annotation_flags").bitwiseAND(K.HIDDEN_BIT) != 0).alias("hidden"))
    hay = page_text.select("doc_id", T.fold_drift(F.col("text")).alias("hay"))
    joined = shown.join(now, ["doc_id", "name"], "left").join(hay, "doc_id", "left")
    rewritten = (F.coalesce("now", F.lit("")) != "") & (F.col("now") != F.col("n"))
    still = F.contains(F.coalesce("hay", F.lit("")), F.col("n"))
    return joined.filter(~F.coalesce("hidden", F.lit(False))).filter(~(rewritten & ~still)).select("doc_id", "name", "caption")


def caption_overflows(buttons: DataFrame, advances: DataFrame) -> DataFrame:
    """(doc_id, name, width, room) captions wider than their rectangle less two points a side.

    Buttons have doc_id, name, caption, x0, x1, y0, y1, font_size; advances (char, advance) are widths at size one.
    """
    size = F.when(F.col("font_size") > 0, F.col("font_size")).otherwise(F.greatest(F.lit(4.0), F.col("y1") - F.col("y0") - 4))
    chars = buttons.filter(F.trim("caption") != "").select("doc_id", "name", (F.col("x1") - F.col("x0") - 4).alias("room"), size.alias("size"), F.explode(F.split(F.trim("caption"), "")).alias("char"))
    few = advances.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    widths = chars.join(F.broadcast(advances) if few else advances, "char", "left").groupBy("doc_id", "name", "room", "size").agg(F.sum(F.coalesce("advance", F.lit(0.5))).alias("w"))
    return widths.withColumn("width", F.col("w") * F.col("size")).filter("width > room").select("doc_id", "name", "width", "room")


def export_keys(choices: DataFrame) -> DataFrame:
    """SRC-7: choice fields (doc_id, ord, name, ...) with a key: the name, and ``(widget n)`` for the nth of the name."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "name").orderBy("ord"))
    return choices.withColumn("key", F.when(nth > 1, F.concat(F.col("name"), F.lit(" (widget "), nth.cast("string"), F.lit(")"))).otherwise(F.col("name")))


def first_widgets(widgets: DataFrame) -> DataFrame:
    """SRC-6: the first widget of each full name (doc_id, name, ord), pushbuttons left out."""
    rank = F.row_number().over(Window.partitionBy("doc_id", "name").orderBy("ord"))
    return widgets.filter(F.col("flags").bitwiseAND(K.PUSHBUTTON_BIT) == 0).withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def full_names(fields: DataFrame, hops: int = 64) -> DataFrame:
    """SRC-8: (id, full_name) dotted names up the parent chain of fields (id, parent, part); cycles end where they
    close and chains after ``hops`` parents. Chains double in length with every join, so few joins are needed."""
    up = fields.select("id", F.coalesce("part", F.lit("")).alias("name"), "parent", F.array("id").alias("seen"))
    steps = 1
    while steps < hops:
        above = up.select(F.col("id").alias("a_id"), F.col("name").alias("a_name"), F.col("parent").alias("a_parent"), F.col("seen").alias("a_seen"))
        joined = up.join(above, (F.col("parent") == F.col("a_id")) & ~F.arrays_overlap("seen", "a_seen"), "left")
        met = F.col("a_id").isNotNull()
        name = F.when(met & (F.col("a_name") != "") & (F.col("name") != ""), F.concat("a_name", F.lit("."), "name")).when(met & (F.col("name") == ""), F.col("a_name")).otherwise(F.col("name"))
        up = joined.select("id", name.alias("name"), F.when(met, F.col("a_parent")).alias("parent"), F.when(met, F.concat("seen", "a_seen")).otherwise(F.col("seen")).alias("seen"))
        steps *= 2
    return up.select("id", F.col("name").alias("full_name"))


def resolved_keys(keys: DataFrame, names: DataFrame) -> DataFrame:
    """JOIN-12: mapping keys (doc_id, key) to full field names (doc_id, name): a full name, or a last part that only one
    field has; (doc_id, key, name, problem): ambiguous, unknown, or two keys for one field."""
    part = names.select("doc_id", F.col("name"), F.element_at(F.split("name", r"\."), -1).alias("key"), F.lit(1).alias("rank"))
    whole = names.select("doc_id", "name", F.col("name").alias("key"), F.lit(0).alias("rank"))
    met = keys.select("doc_id", "key").distinct().join(whole.unionByName(part), ["doc_id", "key"], "left")
    best = met.groupBy("doc_id", "key").agg(F.min("rank").alias("rank"), F.collect_set(F.when(F.col("rank") == 0, F.col("name"))).alias("exact"), F.collect_set("name").alias("any"))
    chosen = F.when(F.size("exact") == 1, F.get("exact", F.lit(0))).when(F.size("any") == 1, F.get("any", F.lit(0)))
    named = best.withColumn("name", chosen).withColumn("_shared", F.count("name").over(Window.partitionBy("doc_id", "name")))
    problem = F.when(F.size("any") == 0, "unknown").when(F.col("name").isNull(), "ambiguous").when(F.col("_shared") > 1, "two-keys")
    return named.select("doc_id", "key", "name", problem.alias("problem"))


def missing_of(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """SET-3: the distinct keys of ``expected`` that ``present`` lacks; nulls are equal to each other."""
    return expected.select(*keys).distinct().exceptAll(present.select(*keys).distinct())


def empty_targets(mapping: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """(core, and doc_id where the mapping has one) authored targets that hold nothing but white space, no-break spaces
    included; null is not authored."""
    found = mapping.filter("target is not null").filter(T.strip(T.fold_drift(T.strip_inline_markup(F.col("target")))) == "")
    return (found.join(skip.select("core"), "core", "left_anti") if skip is not None else found).select(*(c for c in ("doc_id", "core") if c in mapping.columns)).distinct()


def metadata_misses(original: DataFrame, output: DataFrame, mapping: DataFrame, lang: str | None) -> DataFrame:
    """(doc_id, what) document strings (doc_id, lang, title, outline, struct_tree) that the translation left behind."""
    targets = mapping.filter("target is not null and target <> ''").select("core", "target")
    out = output.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.trim(F.coalesce("title", F.lit(""))).alias("title"), "outline", "struct_tree")
    misses = []
    if lang:
        misses.append(out.filter((F.col("lang") == "") | ~T.same_language(F.col("lang"), F.lit(lang))).select("doc_id", F.lit("lang").alias("what")))
    same = out.join(original.select("doc_id", F.trim("title").alias("title")), ["doc_id", "title"]).filter("title <> ''")
    misses.append(same.join(targets, same["title"] == targets["core"], "left_semi").select("doc_id", F.lit("title").alias("what")))
    marks = out.select("doc_id", F.explode("outline").alias("entry"))
    misses.append(marks.join(targets, marks["entry"] == targets["core"], "left_semi").select("doc_id", F.lit("outline").alias("what")))
    misses.append(out.filter("struct_tree").select("doc_id", F.lit("struct-tree").alias("what")))
    first, *rest = misses
    for m in rest:
        first = first.unionByName(m)
    return first


def gate_status(results: DataFrame, fail_on_review: bool = False) -> DataFrame:
    """AGG-6: (doc_id, status, exit_code) of gate rows (doc_id, gate, status): FAIL over REVIEW over PASS; skips and
    absent gates don't count, and a document without judged gates has a null status."""
    rank = F.when(F.col("status") == "FAIL", 3).when(F.col("status") == "REVIEW", 2).when(F.col("status") == "PASS", 1)
    worst = results.groupBy("doc_id").agg(F.max(rank).alias("_w"))
    code = F.when(F.col("_w") == 3, 1).when((F.col("_w") == 2) & F.lit(fail_on_review), 1).otherwise(0)
    return worst.select("doc_id", F.when(F.col("_w") == 3, "FAIL").when(F.col("_w") == 2, "REVIEW").when(F.col("_w") == 1, "PASS").alias("status"), code.alias("exit_code"))


def gate(name: str, problems: DataFrame, judged: DataFrame, bad: str = "FAIL", none: str | None = "PASS") -> DataFrame:
    """One gate's rows (doc_id, gate, ord, status, n_findings) over judged documents (doc_id): ``bad`` where there are
    problems (doc_id), else ``none``, or no row at all where ``none`` is null: a silent gate says nothing."""
    counted = problems.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_findings"))
    rows = judged.select("doc_id").distinct().join(counted, "doc_id", "left").fillna(0, ["n_findings"])
    status = F.when(F.col("n_findings") > 0, bad).otherwise(F.lit(none))
    out = rows.select("doc_id", F.lit(name).alias("gate"), F.lit(K.GATES.index(name)).alias("ord"), status.alias("status"), "n_findings")
    return out.filter("status is not null")
