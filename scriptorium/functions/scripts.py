"""Writing systems: which script letters belong to, and predicates over scripts (SCR-*)."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import constants as K
from scriptorium.functions.arrow import arrow_function


def ranges(text: str) -> list[tuple[int, int]]:
    """Code point ranges of a constant such as ``41-5A AA``."""
    ends = [part.split("-") for part in text.split()]
    return [(int(e[0], 16), int(e[-1], 16)) for e in ends]


def char_class(text: str) -> str:
    """The inside of a regular expression class of the ranges."""
    return "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges(text))


def letters_of(script: str) -> str:
    """SCR-4: the class of a script's letters."""
    return f"[[{char_class(K.SCRIPT_RANGES[script])}]&&\\p{{L}}]"


#: The last code point below which only one script, Latin, has letters; none of the predicates' ranges is below it.
_COMMON_END = 0x24F
assert all(first > _COMMON_END for name, spans in K.SCRIPT_RANGES.items() if name != "Latin" for first, _ in ranges(spans))


def beyond_latin(text: Column) -> Column:
    """The characters of a text beyond the common Latin blocks: what other scripts are looked for in. Empty, or short,
    for most texts, so the many searches that follow cost one pass over the whole text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[\\x{{0}}-\\x{{{_COMMON_END:x}}}]+", "")


def script_counts(text: Column) -> Column:
    """SCR-1: (count, -first place, script) for every script with letters in the text."""
    t = F.coalesce(text, F.lit(""))

    def counted(rest: Column) -> Column:
        each = []
        for name in K.SCRIPT_RANGES:
            found = F.lit(letters_of(name))
            count = F.regexp_count(t if name == "Latin" else rest, found)
            place = F.when(count > 0, -F.regexp_instr(t, found)).otherwise(0)
            each.append(F.struct(count.alias("count"), place.alias("place"), F.lit(name).alias("script")))
        return F.filter(F.array(*each), lambda x: x["count"] > 0)

    return F.get(F.transform(F.array(beyond_latin(text)), counted), F.lit(0))


def dominant_script(text: Column) -> Column:
    """SCR-2: the script of most letters; of equals the one met first; null without letters."""
    return F.array_max(script_counts(text))["script"]


def letter_bag(line: Column) -> Column:
    """The letters of a line in order of code points, as one string."""
    return F.array_join(F.array_sort(F.regexp_extract_all(line, F.lit(r"\p{L}"), F.lit(0))), "")


def target_script(output: Column, source: Column) -> Column:
    """SCR-3: dominant script of the output's lines that are not source lines, verbatim or as the same letters."""
    fold = lambda t: F.btrim(F.regexp_replace(F.translate(t, K.FOLD_FROM, K.FOLD_TO), r"\s+", " "))
    whole = fold(source)
    bags = F.filter(F.transform(F.split(source, r"\r\n|[\n\r]"), letter_bag), lambda b: F.length(b) >= 2)
    kept = F.filter(
        F.split(output, r"\r\n|[\n\r]"),
        lambda line: (fold(line) != "") & ~F.contains(whole, fold(line)) & ~((F.length(letter_bag(line)) >= 2) & F.array_contains(bags, letter_bag(line))),
    )
    return dominant_script(F.array_join(kept, "\n"))


def has_spaceless_script(text: Column) -> Column:
    """SCR-5: a letter of a script written without spaces."""
    return beyond_latin(text).rlike("|".join(letters_of(s) for s in K.SPACELESS_SCRIPTS))


def needs_shaping(text: Column) -> Column:
    """SCR-6."""
    return beyond_latin(text).rlike(f"[{char_class(K.SHAPING_RANGES)}]")


def is_rtl(text: Column) -> Column:
    """SCR-7."""
    return beyond_latin(text).rlike(f"[{char_class(K.RTL_RANGES)}]")


def has_cjk(text: Column) -> Column:
    """SCR-8: a letter in the Han and kana blocks."""
    return beyond_latin(text).rlike(letters_of("CJK"))


def complex_scripts(text: Column) -> Column:
    """SCR-9: the scripts present whose shaping is probed, marks included."""

    def present(rest: Column) -> Column:
        return F.filter(F.array(*(F.when(rest.rlike(f"[{char_class(r)}]"), F.lit(n)) for n, r in K.COMPLEX_SCRIPTS.items())), lambda n: n.isNotNull())

    return F.get(F.transform(F.array(beyond_latin(text)), present), F.lit(0))


_HAN = ranges(K.HAN)
_KANA = ranges(K.KANA)


def _inside(char: str, where: list[tuple[int, int]]) -> bool:
    return any(a <= ord(char) <= b for a, b in where)


def _fits(char: str, encoding: str) -> bool:
    try:
        char.encode(encoding)
    except UnicodeEncodeError:
        return False
    return True


def is_tell(char: str, convention: str | None) -> bool:
    """Whether a character cannot belong to a text of the convention: kana in Chinese, Han outside the repertoire."""
    if convention not in K.REPERTOIRES:
        return False
    if convention != "JP" and _inside(char, _KANA):
        return True
    return _inside(char, _HAN) and not _fits(char, K.REPERTOIRES[convention])


@arrow_function("array<string>")
def tells(text: pd.Series, convention: pd.Series) -> pd.Series:
    """SCR-10: the characters that cannot belong to the convention, in order; codecs exist in Python only."""
    return pd.Series([[c for c in unicodedata.normalize("NFKC", t or "") if is_tell(c, k)] for t, k in zip(text, convention)])


@arrow_function("string")
def convention_of(text: pd.Series) -> pd.Series:
    """SCR-11: the one convention that holds all Han and kana of the text, else null."""

    def one(t: str | None) -> str | None:
        letters = [c for c in unicodedata.normalize("NFKC", t or "") if _inside(c, _HAN) or _inside(c, _KANA)]
        fits = [k for k in K.REPERTOIRES if letters and not any(is_tell(c, k) for c in letters)]
        return fits[0] if len(fits) == 1 else None

    return text.map(one)


def without_allowed(text: Column, allowed: list[str]) -> Column:
    """SCR-12: allowed tokens removed, the longest first, without regard to case."""
    out = text
    for token in sorted(filter(None, allowed), key=len, reverse=True):
        out = F.regexp_replace(out, f"(?i){re.escape(token)}", "")
    return out


def arabic_forms(text: Column) -> Column:
    """SCR-13: how many isolated joining forms and how many connected forms a text has."""
    first = [a for a, _ in ranges(K.ARABIC_GROUPS)]
    pick = lambda steps: "[" + "".join(f"\\x{{{a + s:x}}}" for a in first for s in steps) + "]"
    t = F.coalesce(text, F.lit(""))
    return F.struct(F.regexp_count(t, F.lit(pick((0,)))).alias("isolated"), F.regexp_count(t, F.lit(pick((2, 3)))).alias("connected"))


def drifted(text: Column) -> Column:
    """SCR-14: the drift-prone characters of a text, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[{char_class(K.DRIFT_RANGES)}]"), F.lit(0))


@cache
def latin_letters() -> str:
    """The inside of a class of the letters whose Unicode name says LATIN, read from the names: the script property also
    holds ordinal and unit signs and modifier letters, whose names do not."""
    found = [c for c in range(0x20000) if unicodedata.category(chr(c))[0] == "L" and "LATIN" in unicodedata.name(chr(c), "")]
    starts = [c for i, c in enumerate(found) if not i or found[i - 1] != c - 1]
    ends = [c for i, c in enumerate(found) if i + 1 == len(found) or found[i + 1] != c + 1]
    return char_class(" ".join(f"{a:X}-{b:X}" for a, b in zip(starts, ends)))


def is_plain_text(text: Column) -> Column:
    """SCR-15: the repertoire of styled targets: Latin, Han and kana letters, digits of ASCII and full width, spaces,
    punctuation and symbols. Marks, controls, other scripts' letters and numbers, pictographs and the weight split are
    out; so are line breaks, and code points newer than the JVM's Unicode tables. Null is plain."""
    letters = f"[\\p{{L}}&&[^{latin_letters()}{char_class(K.SCRIPT_RANGES['CJK'])}々]]"
    other = r"[\p{M}\p{C}‖]|[\p{N}&&[^0-9\x{ff10}-\x{ff19}]]|[\p{So}&&[\x{1f000}-\x{10ffff}]]"
    return ~F.coalesce(text, F.lit("")).rlike(f"{other}|{letters}")


def characters(text: Column) -> Column:
    """The distinct characters of a text."""
    return F.array_distinct(F.split(F.coalesce(text, F.lit("")), ""))


def missing_from(text: Column, repertoire: Column) -> Column:
    """SCR-16, SCR-18: visible characters of the text that the repertoire (an array) lacks."""
    return F.array_except(F.filter(characters(text), lambda c: (c != "") & ~c.rlike(r"^[\p{Cc}\p{Cf}]$")), repertoire)


def covers(repertoire: Column, text: Column) -> Column:
    """SCR-18."""
    return F.size(missing_from(text, repertoire)) == 0
