"""Reviewers' findings: validation, verdicts, metrics, and the termbase they feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import constants as K
from scriptorium.functions import text as T


def validated(findings: DataFrame) -> DataFrame:
    """REV-1: findings (..., category, severity, resolution, resolution_note) with error, resolution, note, migrated.

    A resolution that is prose is migrated to the token it begins with, and kept whole as the note. error names the
    first rule broken, null for a valid row: nothing is guessed and nothing is dropped here.
    """
    token = T.leading_token(F.col("resolution"))
    error = (
        F.when(F.col("category").isNull() | ~F.col("category").isin(*K.CATEGORIES), "category")
        .when(F.col("severity").isNull() | ~F.col("severity").isin(*K.SEVERITIES), "severity")
        .when(F.col("resolution").isNull() | ~token.isin(*K.RESOLUTIONS), "resolution")
    )
    migrated = ~F.col("resolution").isin(*K.RESOLUTIONS)
    note = F.when(migrated & (F.coalesce("resolution_note", F.lit("")) == ""), F.col("resolution")).otherwise(F.coalesce("resolution_note", F.lit("")))
    out = findings.withColumn("error", error).withColumn("_note", note).withColumn("migrated", migrated & F.col("error").isNull()).withColumn("_token", token)
    return out.withColumn("resolution", F.when(F.col("error").isNull(), F.col("_token")).otherwise(F.col("resolution"))).withColumn("resolution_note", F.col("_note")).drop("_note", "_token")


def verdicts(valid: DataFrame, jobs: DataFrame, no_review: bool = False) -> DataFrame:
    """AGG-5, REV-2: one row a job (doc_id): counts by severity and resolution, errors, exit code, whether delivery is
    blocked. A job without any finding row has no review: present is false and delivery is blocked."""
    good = F.col("error").isNull()
    counted = valid.groupBy("doc_id").agg(
        F.count_if(~good).alias("n_errors"),
        *(F.count_if(good & (F.col("severity") == s)).alias(f"n_{s}") for s in K.SEVERITIES),
        *(F.count_if(good & (F.col("resolution") == r)).alias(f"n_{r}") for r in K.RESOLUTIONS),
    )
    names = [c for c in counted.columns if c != "doc_id"]
    out = jobs.select("doc_id").distinct().join(counted, "doc_id", "left").withColumn("present", F.col("n_errors").isNotNull()).fillna(0, names)
    code = F.when(F.col("n_errors") > 0, 2).when(F.col("n_open") > 0, 1).otherwise(0)
    blocked = (F.col("n_errors") > 0) | ~F.col("present") | (F.col("n_open") > 0)
    line = F.when(F.lit(no_review), "no-review").when(F.col("n_errors") > 0, "invalid").when(~F.col("present"), "no-reviser").when(F.col("n_open") > 0, "open").otherwise("")
    return out.select("doc_id", *names, "present", code.alias("exit_code"), blocked.alias("blocks_delivery"), line.alias("review_line"))


def reviewer_metrics(valid: DataFrame, source_words: DataFrame) -> DataFrame:
    """AGG-14: (doc_id, accepted_per_1000, false_positive_rate) against the number of source words (doc_id, n_words);
    null where there is nothing to measure by."""
    good = valid.filter("error is null").groupBy("doc_id").agg(
        F.count_if((F.col("category") == "terminology") & (F.col("resolution") == "accepted")).alias("accepted"),
        F.count_if(F.col("resolution") == "rejected").alias("rejected"),
        F.count_if(F.col("resolution") != "open").alias("decided"),
    )
    out = source_words.join(good, "doc_id", "left")
    per = F.when((F.col("n_words") > 0) & F.col("accepted").isNotNull(), F.col("accepted") * 1000.0 / F.col("n_words"))
    return out.select("doc_id", per.alias("accepted_per_1000"), F.when(F.col("decided") > 0, F.col("rejected") / F.col("decided")).alias("false_positive_rate"))


def term_rows(valid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """AGG-16: (source, target, ord) of accepted terminology findings that name both terms, and the skipped (core)."""
    accepted = valid.filter("error is null and category = 'terminology' and resolution = 'accepted'")
    both = (F.coalesce("term", F.lit("")) != "") & (F.coalesce("term_target", F.lit("")) != "")
    return accepted.filter(both).select(F.trim("term").alias("source"), F.trim("term_target").alias("target"), "ord"), accepted.filter(~both).select("core")


def termbase_merge(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """JOIN-14: (source, existing, target, action) for new rows (source, target, ord) against a termbase (source,
    target, ord): ``added`` for the first row of a new source, ``conflict`` for another target, ``present`` for the
    same. The first target of a source in the termbase, or else among the new rows, is the one that counts."""
    first = lambda df: df.filter("source <> '' and target <> ''").groupBy("source").agg(F.min_by("target", "ord").alias("first"), F.min("ord").alias("first_ord"))
    old, new = first(existing).select("source", F.col("first").alias("old")), first(rows)
    judged = rows.filter("source <> '' and target <> ''").join(new, "source").join(old, "source", "left")
    standing = F.coalesce("old", "first")
    added = F.col("old").isNull() & (F.col("ord") == F.col("first_ord"))
    action = F.when(added, "added").when(standing != F.col("target"), "conflict").otherwise("present")
    return judged.select("source", standing.alias("existing"), "target", "ord", action.alias("action"))


def review_pairs(segments: DataFrame, mapping: DataFrame) -> DataFrame:
    """SNK-5: (doc_id, markdown): a table of source and target for a reviser, bars and line breaks made safe."""
    cell = lambda c: F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " "), F.lit("|"), F.lit("\\|"))
    rows = segments.filter(~F.col("passthrough")).join(mapping.select("core", "target"), "core", "left")
    line = F.concat(F.lit("| "), cell(F.col("core")), F.lit(" | "), cell(F.regexp_replace("target", K.WEIGHT_SPLIT, " ")), F.lit(" |"))
    gathered = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "id", line.alias("line")))).alias("m"))
    return gathered.select("doc_id", F.concat(F.lit("| source | target |\n|---|---|\n"), F.array_join("m.line", "\n")).alias("markdown"))


def matched_occurrences(findings: DataFrame, occurrences: DataFrame) -> DataFrame:
    """JOIN-17: findings (finding_no, core, target, occurrence_id, source_runs) with the problem of their identity, or
    null: exactly one occurrence (occurrence_id, source_text, target_text, runs) may fit, with the same target and
    all named runs its own. Without an occurrence_id a core that several occurrences share is ambiguous."""
    o = occurrences.select(F.col("occurrence_id").alias("o_id"), "source_text", "target_text", "runs")
    named = F.col("occurrence_id").isNull() | (F.col("occurrence_id") == F.col("o_id"))
    met = findings.join(o, (F.col("core") == F.col("source_text")) & named, "left")
    fits = (F.col("target") == F.col("target_text")) & (F.col("source_runs").isNull() | (F.size(F.array_except("source_runs", "runs")) == 0))
    counted = met.groupBy("finding_no").agg(F.count("o_id").alias("n"), F.count_if(fits).alias("n_fit"))
    problem = F.when(F.col("n") == 0, "unknown").when(F.col("n") > 1, "shared").when(F.col("n_fit") == 0, "mismatch")
    return counted.select("finding_no", problem.alias("problem"))


def mapping_coverage(targets: DataFrame, occurrences: DataFrame) -> DataFrame:
    """JOIN-26: (occurrence_id, problem): unknown, duplicate or missing occurrences of a mapping (occurrence_id)."""
    t = targets.groupBy("occurrence_id").agg(F.count(F.lit(1)).alias("n"))
    o = occurrences.select("occurrence_id").distinct().withColumn("known", F.lit(True))
    problem = F.when(F.col("known").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate")
    return t.join(o, "occurrence_id", "full_outer").select("occurrence_id", problem.alias("problem")).filter("problem is not null")


def survived(before: DataFrame, after: DataFrame) -> DataFrame:
    """AGG-15: (doc_id, kept, total) identifiers (doc_id, snippet) that are still there."""
    there = after.select("doc_id", "snippet").distinct().withColumn("_t", F.lit(1))
    return before.select("doc_id", "snippet").distinct().join(there, ["doc_id", "snippet"], "left").groupBy("doc_id").agg(F.count("_t").alias("kept"), F.count(F.lit(1)).alias("total"))


def refusal(kinds: Column) -> Column:
    """PLC-4: the refusal that is raised of an array of kinds: glyphs before mappings before placement."""
    return F.when(F.array_contains(kinds, "glyph"), "glyph").when(F.array_contains(kinds, "mapping"), "mapping").when(F.array_contains(kinds, "placement"), "placement")
