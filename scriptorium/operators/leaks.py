"""Text that was left in the source language: runs of source words, script runs, drifted and impossible characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import constants as K
from scriptorium.functions import scripts as S
from scriptorium.functions import text as T

WORD = r"[A-Za-z][A-Za-z'\-]*"
SOURCE_WORD = r"[A-Za-z][A-Za-z'\-]{3,}"


def source_words(texts: DataFrame, allow: DataFrame | None = None, script: str = "Latin") -> DataFrame:
    """AGG-7: (doc_id, word) distinct lower-case words of countable length of each document, without the allowed ones."""
    least = K.MIN_WORD_LETTERS.get(script, K.OTHER_MIN_WORD_LETTERS)
    pattern = SOURCE_WORD if script == "Latin" else f"{S.letters_of(script)}{{{least},}}"
    words = texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("word")).select("doc_id", F.lower("word").alias("word")).distinct()
    return words if allow is None else words.join(allow.select(F.lower("word").alias("word")), "word", "left_anti")


def tokens(texts: DataFrame, script: str = "Latin") -> DataFrame:
    """(doc_id, pos, token) words of each text in order."""
    pattern = WORD if script == "Latin" else f"{S.letters_of(script)}+"
    return texts.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("pos", "token"))


def source_word_runs(output: DataFrame, words: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """WIN-6: (doc_id, start, n_words, run, bucket): islands of tokens that are source words of their document.

    Three words or more in a row are ``running``, fewer ``isolated``. A run that equals a kept phrase (doc_id, key by
    ``run_key``) is no leak. Consecutive hits share the difference of position and rank, so the islands need one
    window over the hits only.
    """
    hits = tokens(output).withColumn("word", F.lower("token")).join(words, ["doc_id", "word"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    islands = hits.withColumn("_island", F.col("pos") - rank).groupBy("doc_id", "_island").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("n_words"), F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("m"))
    runs = islands.select("doc_id", "start", "n_words", F.array_join("m.token", " ").alias("run"))
    runs = runs.withColumn("bucket", F.when(F.col("n_words") >= 3, "running").otherwise("isolated"))
    return runs if keep is None else without_kept(runs, keep)


def without_kept(runs: DataFrame, keep: DataFrame, script: str = "Latin") -> DataFrame:
    """WIN-9: runs (doc_id, run, ...) that equal no kept phrase (doc_id, phrase) in letters-only form."""
    phrases = keep.select("doc_id", T.run_key(F.col("phrase"), script).alias("_key")).filter("_key <> ''").distinct()
    return runs.withColumn("_key", T.run_key(F.col("run"), script)).join(phrases, ["doc_id", "_key"], "left_anti").drop("_key")


def _chunks(text: Column, script: str) -> Column:
    """Sequences of words with only white space between: the text is cut at whatever is neither."""
    if script == "Latin":
        # a word begins with a letter; other marks between words end a sequence
        cut = F.regexp_replace(text, r"(?<![A-Za-z'\-])['\-]+|[^A-Za-z'\-\s]+", "\u0001")
        return F.split(cut, "\u0001")
    least = K.MIN_WORD_LETTERS.get(script, K.OTHER_MIN_WORD_LETTERS)
    inside = S.letters_of(script)
    cut = F.regexp_replace(text, f"(?<!{inside}){inside}{{1,{least - 1}}}(?!{inside})|(?!{inside}|\\s).", "\u0001") if least > 1 else F.regexp_replace(text, f"(?!{inside}|\\s).", "\u0001")
    return F.split(cut, "\u0001")


def script_runs(texts: DataFrame, script: str = "Latin", allow: list[str] | None = None) -> DataFrame:
    """WIN-7, WIN-8: (doc_id, run, n_words, bucket) runs of words, or in spaceless scripts of characters, of a script.

    Three words or more with only white space between are ``running`` if three of them are not allowed; in spaceless
    scripts six characters or more. The text is cut into chunks and counted, as a repeated group over a long text
    would overflow the stack of the regular expression engine.
    """
    allowed = F.array(*(F.lit(a.lower()) for a in allow or [])).cast("array<string>")
    if script in K.SPACELESS_SCRIPTS:
        found = texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{S.letters_of(script)}+"), F.lit(0))).alias("run"))
        kept = found.filter(~F.array_contains(allowed, F.lower("run")))
        return kept.select("doc_id", "run", F.lit(1).alias("n_words"), F.when(F.length("run") >= K.SPACELESS_RUN_CHARS, "running").otherwise("isolated").alias("bucket"))
    chunk = F.explode(_chunks(F.col("text"), script)).alias("chunk")
    words = F.filter(F.split(F.col("chunk"), r"\s+"), lambda w: w != "")
    listed = texts.select("doc_id", chunk).select("doc_id", words.alias("words")).filter(F.size("words") > 0)
    # hyphens join a token, but its parts are counted
    parts = F.regexp_extract_all(F.array_join("words", " "), F.lit("[A-Za-z']+" if script == "Latin" else f"{S.letters_of(script)}+"), F.lit(0))
    counted = F.size(F.filter(parts, lambda w: ~F.array_contains(allowed, F.lower(w))))
    long = listed.filter(F.size("words") >= 3).filter(counted >= 3)
    running = long.select("doc_id", F.array_join("words", " ").alias("run"), F.size("words").alias("n_words"), F.lit("running").alias("bucket"))
    short = listed.filter(F.size("words") < 3).select("doc_id", F.explode("words").alias("run"))
    least = K.MIN_WORD_LETTERS.get(script, K.OTHER_MIN_WORD_LETTERS)
    isolated = short.filter((F.length("run") >= least) & ~F.array_contains(allowed, F.lower("run")))
    return running.unionByName(isolated.select("doc_id", "run", F.lit(1).alias("n_words"), F.lit("isolated").alias("bucket")))


def drifted_characters(output: DataFrame, authored: DataFrame) -> DataFrame:
    """SCR-14: (doc_id, char, count) drift-prone characters of the output that nobody authored in that document."""
    found = output.select("doc_id", F.explode(S.drifted(F.col("text"))).alias("char")).groupBy("doc_id", "char").agg(F.count(F.lit(1)).alias("count"))
    known = authored.select("doc_id", F.explode(F.array_distinct(S.drifted(F.col("text")))).alias("char")).distinct()
    return found.join(known, ["doc_id", "char"], "left_anti")


def unshaped_arabic(pages: DataFrame) -> DataFrame:
    """SCR-13: (doc_id, page, isolated) pages with three or more isolated forms and no connected one."""
    forms = S.arabic_forms(F.col("text"))
    counted = pages.select("doc_id", "page", forms.alias("f")).groupBy("doc_id", "page").agg(F.sum("f.isolated").alias("isolated"), F.sum("f.connected").alias("connected"))
    return counted.filter("connected = 0 and isolated >= 3").select("doc_id", "page", "isolated")


def arabic_judged(pages: DataFrame) -> DataFrame:
    """(doc_id) documents with any of the forms: the others have nothing to judge."""
    forms = S.arabic_forms(F.col("text"))
    return pages.filter((forms["isolated"] > 0) | (forms["connected"] > 0)).select("doc_id").distinct()


def tell_lines(lines: DataFrame, source: str, target: str, allow: list[str] | None = None) -> DataFrame:
    """Lines (doc_id, line_no, text) with characters impossible in the target convention: (doc_id, line_no, n_tells,
    status). FAIL where the pair separates surely and a line has enough of them, else REVIEW."""
    shown = lines.filter(S.has_cjk(F.col("text"))).withColumn("text", S.without_allowed(F.col("text"), allow or []))
    counted = shown.withColumn("n_tells", F.size(S.tells("text", F.lit(target)))).filter("n_tells > 0")
    strong = (source, target) in K.STRONG_PAIRS
    return counted.select("doc_id", "line_no", "n_tells", F.when(F.lit(strong) & (F.col("n_tells") >= K.LINE_FAIL), "FAIL").otherwise("REVIEW").alias("status"))
