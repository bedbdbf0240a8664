"""Checks of authored translations: one pair at a time, across pairs, and against a termbase."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import constants as K
from scriptorium.functions import scripts as S
from scriptorium.functions import text as T

#: Up to so many terms are broadcast to the pairs; above, pairs and terms meet on the terms' words.
BROADCAST_TERMS = 10_000


def _finding(when: Column, kind: str, severity: str, detail: Column) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), detail.alias("detail")))


def pair_findings(pairs: DataFrame, spaceless_target: Column, identifiers: DataFrame | None = None, plain: bool = False) -> DataFrame:
    """QA-1: (core, target, kind, severity, detail) for each defect of a pair (core, target).

    Dates, numbers, untranslated text, brackets, closing punctuation, spacing and length; all checks are columns of
    one projection. ``identifiers`` (core) may stay as they are. ``spaceless_target``: whether the targets' script
    has no spaces, where short targets are no finding. Null targets are not checked.
    """
    checked = pairs.filter("core is not null and target is not null")
    if identifiers is not None:
        checked = checked.join(identifiers.select("core").distinct().withColumn("_identifier", F.lit(True)), "core", "left")
    else:
        checked = checked.withColumn("_identifier", F.lit(False))
    core, target = F.col("core"), F.col("target") if plain else F.replace(T.strip_inline_markup(F.col("target")), F.lit(K.WEIGHT_SPLIT), F.lit(""))
    src_dates, tgt_dates = F.array_sort(T.date_parts(core)), F.array_sort(T.date_parts(target))
    src_numbers, tgt_numbers = T.number_tokens(T.strip_dates(core)), T.number_tokens(T.strip_dates(target))
    opened = F.array_except(T.unbalanced_pairs(target), T.unbalanced_pairs(core))
    src_end, tgt_end = T.last_char(core), T.last_char(target)
    closers = [F.lit(c) for c in K.CLOSERS]
    length = F.length(T.strip(core))
    ratio = F.length(T.strip(target)) / length
    listed = lambda x: F.array_join(x, ",")
    between = lambda a, b: F.concat(a, F.lit(" > "), b)
    findings = F.array(
        _finding(src_dates != tgt_dates, "dates", "error", between(listed(T.raw_dates(core)), listed(T.raw_dates(target)))),
        _finding((src_dates == tgt_dates) & (F.size(src_dates) > 0) & (T.raw_dates(core) != T.raw_dates(target)), "dates", "warn", between(listed(T.raw_dates(core)), listed(T.raw_dates(target)))),
        _finding(src_numbers != tgt_numbers, "numbers", "error", between(listed(src_numbers), listed(tgt_numbers))),
        _finding((T.strip(target) == T.strip(core)) & ~F.coalesce("_identifier", F.lit(False)), "untranslated", "warn", F.lit("")),
        _finding(F.size(opened) > 0, "brackets", "error", listed(opened)),
        _finding((src_end.isin(*closers) | tgt_end.isin(*closers)) & (src_end != tgt_end), "punctuation", "warn", between(src_end, tgt_end)),
        _finding(T.has_double_space(target), "spacing", "warn", F.lit("doubled space")),
        _finding(T.has_space_before_punctuation(target) & ~T.has_space_before_punctuation(core), "spacing", "warn", F.lit("space before punctuation")),
        _finding((length > 0) & (ratio > T.expansion_limit(length)), "length", "warn", F.lit("long")),
        _finding((length > 0) & (ratio <= T.expansion_limit(length)) & (ratio < K.SHRINK_FLOOR) & ~spaceless_target, "length", "warn", F.lit("short")),
    )
    return checked.select(*pairs.columns, F.explode(F.filter(findings, lambda x: x.isNotNull())).alias("f")).select(*pairs.columns, "f.kind", "f.severity", "f.detail")


def target_script(pairs: DataFrame) -> DataFrame:
    """The dominant script of all targets together, one row (script): letters are counted a row, then summed."""
    counts = pairs.select(F.explode(S.script_counts(F.col("target"))).alias("c")).groupBy(F.col("c.script").alias("script")).agg(F.sum("c.count").alias("n"))
    return counts.agg(F.max_by("script", F.struct("n", "script")).alias("script"))


def inconsistent(pairs: DataFrame) -> DataFrame:
    """AGG-3: (key, core, n_members, n_targets): cores equal but for case and punctuation, translated differently.

    core is the first of the group in order of the text. Groups are counted by partial aggregates, never collected.
    """
    keyed = pairs.filter("target is not null").select(T.normalize_key(F.col("core")).alias("key"), "core", T.normalize_key(F.col("target")).alias("tkey"))
    distinct = keyed.groupBy("key", "tkey").agg(F.min("core").alias("core"), F.count(F.lit(1)).alias("n"))
    groups = distinct.groupBy("key").agg(F.min("core").alias("core"), F.sum("n").alias("n_members"), F.count(F.lit(1)).alias("n_targets"))
    return groups.filter("n_members > 1 and n_targets > 1")


def glossary_findings(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """JOIN-4: (core, target, term, term_target): a source term in the core whose target term is not in the target.

    A small termbase, its size checked, is broadcast and tested against every core. A large one meets the cores on the
    term's first three characters, which any core that contains the term has somewhere; both ways find the same.
    """
    folded = terms.select(F.col("source").alias("term"), F.col("target").alias("term_target")).distinct()
    small = folded.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    shown = pairs.filter("core is not null and target is not null")
    inside = T.contains_folded(F.col("core"), F.col("term")) & ~T.contains_folded(T.strip_inline_markup(F.col("target")), F.col("term_target"))
    if small:
        return shown.join(F.broadcast(folded), inside).select(*pairs.columns, "term", "term_target")
    first = F.substring(T.casefold(F.col("term")), 1, 3)
    sizes = [r["n"] for r in folded.select(F.length(first).alias("n")).distinct().collect()]  # 1, 2, 3 at most

    def pieces(c: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(n)))

    found = F.array_distinct(F.flatten(F.array(*(pieces(T.casefold(F.col("core")), n) for n in sizes))))
    by_piece = shown.withColumn("_piece", F.explode(found))
    keyed = folded.withColumn("_piece", first)
    return by_piece.join(keyed, "_piece").filter(inside).select(*pairs.columns, "term", "term_target").distinct()


def identifier_cores(lines: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """QA-3: (core) distinct stripped texts with something to write, find or say, plus the allowed ones."""
    found = lines.filter(F.size(T.write_find_say(F.col("text"))) > 0).select(T.strip(F.col("text")).alias("core"))
    return (found.unionByName(allowed.select("core")) if allowed is not None else found).distinct()


def ordered(findings: DataFrame) -> DataFrame:
    """SRT-1: errors first, then by kind and core."""
    return findings.orderBy(F.when(F.col("severity") == "error", 0).otherwise(1), "kind", "core")


def verdict(findings: DataFrame) -> DataFrame:
    """AGG-4: one row: n_errors, n_warnings, ok, exit_code."""
    counted = findings.agg(F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warn").alias("n_warnings"))
    return counted.withColumn("ok", F.col("n_errors") == 0).withColumn("exit_code", F.when(F.col("n_errors") > 0, 1).otherwise(0))


def merged_mappings(entries: DataFrame, last_wins: bool = False) -> DataFrame:
    """JOIN-15: mapping entries (core, target, ord) of several files as one: (core, target, conflict).

    A null target yields to an authored one. Two authored targets conflict, unless the last file wins.
    """
    return entries.groupBy("core").agg(
        (F.max_by("target", F.when(F.col("target").isNotNull(), F.col("ord"))) if last_wins else F.min_by("target", F.when(F.col("target").isNotNull(), F.col("ord")))).alias("target"),
        (F.lit(False) if last_wins else F.count_distinct("target") > 1).alias("conflict"),
    )


def qa_check(entries: DataFrame, skip: DataFrame | None = None, identifiers: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    """QA-2: all findings of a mapping (core, target) in the report's order: (core, kind, severity, detail).

    Null targets and skipped cores (core) are not checked. Pairs, consistency between pairs and, with ``terms``
    (source, target), the glossary. Whether short targets are findings depends on the script of all targets together.
    """
    pairs = entries.filter("core is not null and target is not null").select("core", "target")
    if skip is not None:
        pairs = pairs.join(skip.select("core").distinct(), "core", "left_anti")
    script = target_script(pairs).first()["script"]  # one row
    found = [pair_findings(pairs, F.lit(script in K.SPACELESS_SCRIPTS), identifiers).select("core", "kind", "severity", "detail")]
    apart = inconsistent(pairs)
    found.append(apart.select("core", F.lit("consistency").alias("kind"), F.lit("warn").alias("severity"), F.concat("n_targets", F.lit(" translations")).alias("detail")))
    if terms is not None:
        missing = glossary_findings(pairs, terms)
        found.append(missing.select("core", F.lit("glossary").alias("kind"), F.lit("error").alias("severity"), F.concat("term", F.lit(" > "), "term_target").alias("detail")))
    return ordered(reduce(DataFrame.unionByName, found))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
