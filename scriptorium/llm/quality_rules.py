"""Line-first cleaning with whole-document repetition rules, all in native expressions.

Each line is judged by itself: punctuation, navigation and boilerplate rules mark it as failed. Failed lines are
removed, and a document that loses too large a share of its words is rejected. Before that, base rules over the whole
text reject what is too short or too repetitive. Every row is judged within itself: the plan has one projection, no
shuffle and no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.native import columns_of, fresh, let, quoted, with_text, words_of

#: Fixed phrases of site furniture, matched without regard to case in lines of at most ``boilerplate_words`` words.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "uses cookies",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "enable javascript",
    "javascript is disabled",
    "subscribe to our newsletter",
    "sign up for our newsletter",
    "click here to",
    "share on facebook",
    "share on twitter",
    "skip to content",
    "skip to main content",
    "back to top",
    "lorem ipsum",
)
SYMBOLS = "[#*$%&|<>]"
_TERMINAL = r"""[.!?…。！？:;]["')\]”’»]*[\x20\x09-\x0D]*$"""
_SEPARATORS = r"[|»›•·]"


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line and document rules."""

    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    symbol_share: float = 0.3  # symbols a word, above which a line is junk
    shout_share: float = 0.3  # words ending in "!!", above which a line is junk
    navigation_share: float = 0.25  # separators a word, above which a line is navigation
    fragment_words: int = 3  # a line without closing punctuation needs as many words
    boilerplate_words: int = 20
    max_lost_share: float = 0.5


def repeated_words(words: Column, window: int) -> Column:
    """How many words stand in windows of ``window`` words that occur twice or more in the text, the first included.

    Windows are compared by a 64-bit hash chained over their words (about 1e-11 chance of a wrong meeting in a text of
    20,000 words). Texts without any repeat, the usual case, stop after a hash set; the others sort (hash, position)
    and count the union of the repeated windows, so the time is n log n in the number of words.
    """

    def covered(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            twin = F.filter(
                s,
                lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < F.size(s) - 1) & (F.get(s, k + 1)["h"] == x["h"])),
            )
            return F.sort_array(F.transform(twin, lambda x: x["i"]))

        start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("sum"))
        return F.aggregate(
            let(by_hash, positions),
            start,
            lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(window), p - acc["last"])).alias("sum")),
            lambda acc: acc["sum"],
        )

    def over(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(window))))
        return F.when(F.size(w) <= window, F.lit(0)).otherwise(
            let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
        )

    return let(words, over)


def line_fails(line: Column, rules: LineRules = LineRules()) -> Column:
    """Whether a line is symbol junk, shouting, navigation, boilerplate or a fragment; a wordless line never fails."""

    def judged(n: Column) -> Column:
        symbols = F.regexp_count(line, F.lit(SYMBOLS))
        shouts = F.regexp_count(line, F.lit("!!"))
        separators = F.regexp_count(line, F.lit(_SEPARATORS))
        phrases = "(?i)" + "|".join(BOILERPLATE)
        return (
            ((n >= 3) & (symbols > n * rules.symbol_share))
            | ((n >= 3) & (shouts > n * rules.shout_share))
            | ((separators >= 3) & (separators > n * rules.navigation_share))
            | ((n <= rules.boilerplate_words) & line.rlike(phrases))
            | ((n < rules.fragment_words) & ~line.rlike(_TERMINAL))
        )

    return let(F.size(words_of(line)), lambda n: (n > 0) & judged(n))


def verdict_of(text: Column, rules: LineRules = LineRules()) -> Column:
    """A struct of the measures, base_failed, kept and the cleaned text of a text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.split(text, "\n")

    def measures(w: Column) -> Column:
        with_word = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w, rules.window).cast("long").alias("n_repeat_words"),
            let(F.filter(lines, lambda x: ~line_fails(x, rules)), lambda x: F.array_join(x, "\n")).alias("clean_text"),
        )

    def verdict(m: Column) -> Column:
        failed = (m["n_words"] < rules.min_words) | (m["n_repeat_words"] * 100 > m["n_words"] * rules.max_repeat_percent)
        left = F.size(words_of(m["clean_text"]))
        kept = ~failed & ((m["n_words"] - left) <= m["n_words"] * rules.max_lost_share)
        fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_text")
        return F.struct(*(m[f].alias(f) for f in fields), failed.alias("base_failed"), kept.alias("kept"))

    return let(let(words_of(text), measures), verdict)


def judged(docs: DataFrame, rules: LineRules = LineRules(), name: str = "quality") -> DataFrame:
    """``docs`` plus a struct column ``name``: the measures, base_failed, kept and the cleaned text.

    Defined cases: a null text counts as empty and is rejected (no words); blank lines neither fail nor count; a text
    of one very long line or of very many lines is judged whole; repeated rows are judged alike; an empty table gives
    an empty result; other columns, whatever their names, are carried along, but a column of that name, in any case,
    is replaced.
    """
    return docs.select(*columns_of(docs, without=[name]), verdict_of(F.col("text"), rules).alias(name))


def cleaned(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The kept documents with their failed lines removed and ``n_chars``, if present, brought up to date.

    The verdict is exploded from an array that holds it if the document is kept: a filter on it would be pushed below
    the projection and compute it a second time.
    """
    verdict = fresh(docs, "verdict")
    kept = F.filter(F.array(verdict_of(F.col("text"), rules)), lambda v: v["kept"])
    out = docs.select(*columns_of(docs), F.explode(kept).alias(verdict))
    return with_text(out, F.col(f"{verdict}.clean_text")).select(*(F.col(quoted(c)) for c in docs.columns))
