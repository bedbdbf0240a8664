"""String normalisation, parsing and comparison of segments and of source and target strings (STR-*, PRJ-*)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import constants as K
from scriptorium.functions.arrow import arrow_function

#: White space at the ends of a text, Unicode spaces and separators included.
EDGES = r"^[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$"


def _or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """The text without white space at its ends, Unicode spaces included."""
    return F.regexp_replace(text, EDGES, "")


def normalize_ws(text: Column) -> Column:
    """STR-1: wrapping white space collapsed to one space, ends trimmed, nothing else folded."""
    return strip(F.regexp_replace(_or_empty(text), K.WRAP_SPACE, " "))


def fold_drift(text: Column) -> Column:
    """STR-2: no-break and figure spaces to a space, odd hyphens to a hyphen."""
    return F.translate(_or_empty(text), K.FOLD_FROM, K.FOLD_TO)


def casefold(text: Column) -> Column:
    """Lower case with the sharp s as two letters."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


@arrow_function("string")
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition; no built-in expression does it, so Arrow batches carry it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalize_key(text: Column, compose: Callable[[Column], Column] | None = None) -> Column:
    """STR-3: case-folded, without punctuation, white space collapsed. ``compose=nfkc`` adds compatibility composition."""
    base = compose(_or_empty(text)) if compose else _or_empty(text)
    return strip(F.regexp_replace(casefold(F.regexp_replace(base, r"\p{P}", "")), r"\s+", " "))


def run_key(text: Column, script: str = "Latin") -> Column:
    """STR-4: letters-only words of countable length, lower case; in spaceless scripts the text without white space."""
    folded = F.lower(fold_drift(text))
    if script in K.SPACELESS_SCRIPTS:
        return F.regexp_replace(folded, r"\s+", "")
    least = K.MIN_WORD_LETTERS.get(script, K.OTHER_MIN_WORD_LETTERS)
    words = F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{M}]+"), F.lit(0))
    return F.array_join(F.filter(words, lambda w: F.length(w) >= least), " ")


def _no_zeros(digits: Column) -> Column:
    return F.regexp_replace(digits, "^0+(?=.)", "")


def number_tokens(text: Column) -> Column:
    """STR-5: digit groups without separators and leading zeros, sorted."""
    found = F.regexp_extract_all(_or_empty(text), F.lit(K.NUMBER), F.lit(0))
    return F.array_sort(F.transform(found, lambda x: _no_zeros(F.regexp_replace(x, r"\P{Nd}", ""))))


def raw_dates(text: Column) -> Column:
    """Date-shaped strings in order."""
    return F.regexp_extract_all(_or_empty(text), F.lit(K.DATE), F.lit(0))


def date_parts(text: Column) -> Column:
    """STR-6: for each date-shaped string its three parts without leading zeros, sorted as strings, joined by ``|``."""

    def parts(raw: Column) -> Column:
        return F.array_join(F.array_sort(F.transform(F.split(raw, r"[./\-]"), _no_zeros)), "|")

    return F.transform(raw_dates(text), parts)


def strip_dates(text: Column) -> Column:
    return F.regexp_replace(_or_empty(text), K.DATE, " ")


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def unbalanced_pairs(text: Column) -> Column:
    """STR-7: bracket pairs opened and closed a different number of times, and an odd straight quote."""
    t = _or_empty(text)
    marks = [F.when(_count(t, p[0]) != _count(t, p[1]), F.lit(p)) for p in K.PAIRS]
    marks.append(F.when(_count(t, '"') % 2 == 1, F.lit('""')))
    return F.filter(F.array(*marks), lambda x: x.isNotNull())


def expansion_limit(length: Column) -> Column:
    """STR-8: how many times its length a source string of a length may grow to."""
    return reduce(lambda rest, band: F.when(length <= band[0], F.lit(band[1])).otherwise(rest), reversed(K.EXPANSION_BANDS), F.lit(K.EXPANSION_BANDS[-1][1]))


def has_double_space(text: Column) -> Column:
    """STR-9."""
    return text.rlike(K.DOUBLE_SPACE)


def has_space_before_punctuation(text: Column) -> Column:
    """STR-9."""
    return text.rlike(K.SPACE_BEFORE_PUNCTUATION)


def last_char(text: Column) -> Column:
    """STR-10: the last character that is no white space; empty for none."""
    return F.right(strip(_or_empty(text)), F.lit(1))


def shown(text: Column, chars: int) -> Column:
    """STR-11: cut for display; the full value stays in its own column."""
    return F.substring(text, 1, chars)


def utf16_hex(text: Column) -> Column:
    """STR-12."""
    return F.hex(F.encode(text, "UTF-16BE"))


def contains_folded(text: Column, part: Column) -> Column:
    """STR-13: containment without regard to case."""
    return F.contains(casefold(text), casefold(part))


def marker(text: Column) -> Column:
    """PRJ-2: the list marker at a line's start, empty for none."""
    return strip(F.regexp_extract(text, K.MARKER, 0))


def marker_gap(text: Column) -> Column:
    """PRJ-2: the white space printed between a list marker and the body, verbatim; the text starts with its marker."""
    return F.regexp_extract(text, r"^\S+?(\s+)", 1)


def without_marker(text: Column) -> Column:
    return F.when(text.rlike(K.MARKER), strip(F.regexp_replace(text, K.MARKER, ""))).otherwise(text)


def leader_parts(text: Column) -> Column:
    """PRJ-3: core, leader dots and currency tail of a line; the whole text is the core where no leader ends it."""
    found = text.rlike(K.LEADER)
    return F.struct(
        F.when(found, strip(F.regexp_extract(text, K.LEADER, 1))).otherwise(text).alias("core"),
        F.when(found, F.regexp_extract(text, K.LEADER, 2)).otherwise(F.lit("")).alias("dots"),
        F.when(found, strip(F.regexp_extract(text, K.LEADER, 3))).otherwise(F.lit("")).alias("tail"),
    )


def is_passthrough(core: Column) -> Column:
    """PRJ-4: nothing to translate: no letters."""
    return (core == "") | core.rlike(K.PASSTHROUGH)


def has_inner_gap(text: Column) -> Column:
    """PRJ-5."""
    return text.rlike(K.INNER_GAP)


def write_find_say(text: Column) -> Column:
    """PRJ-6: (kind, snippet) of quoted strings, form names, addresses: what usually stays verbatim."""
    t = _or_empty(text)

    def hits(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("snippet")))

    return F.concat(hits("quoted", K.QUOTED), hits("form-name", K.FORM_NAME), hits("url-or-email", K.URL_EMAIL))


def strip_inline_markup(text: Column) -> Column:
    """PRJ-13: bold and italic tags removed."""
    return F.regexp_replace(_or_empty(text), K.INLINE_TAGS, "")


def html_plain(html: Column) -> Column:
    """PRJ-13: line breaks to spaces, every other tag removed."""
    return F.regexp_replace(F.regexp_replace(_or_empty(html), r"(?i)<br\s*/?>", " "), "<[^>]+>", "")


def escape_keeping(text: Column, tags: tuple[str, ...] = ("b", "i", "em", "strong")) -> Column:
    """PRJ-14: HTML-escaped, except for the listed plain tags."""
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(out, rf"(?i)&lt;(/?(?:{'|'.join(tags)}))\s*(/?)&gt;", "<$1$2>")


def weight_parts(text: Column) -> Column:
    """PRJ-15: the parts around a weight split."""
    return F.split(_or_empty(text), K.WEIGHT_SPLIT)


def with_language(xmp: Column, lang: Column) -> Column:
    """PRJ-16: the first language item of the metadata's language bag replaced."""
    return F.concat(
        F.regexp_extract(xmp, r"(?s)^(.*?<dc:language>.*?<rdf:li[^>]*>)[^<]*(</rdf:li>.*)$", 1),
        lang,
        F.regexp_extract(xmp, r"(?s)^(.*?<dc:language>.*?<rdf:li[^>]*>)[^<]*(</rdf:li>.*)$", 2),
    )


def primary_subtag(tag: Column) -> Column:
    """PRJ-17: the language itself, lower case."""
    return F.lower(F.element_at(F.split(strip(_or_empty(tag)), "-"), 1))


def script_subtag(tag: Column) -> Column:
    """PRJ-17: the four-letter script of a language tag, lower case, or null; it stands before region and extensions."""
    parts = F.split(strip(_or_empty(tag)), "-")
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    before = F.aggregate(
        rest,
        F.struct(F.lit(False).alias("done"), F.lit(None).cast("string").alias("script")),
        lambda acc, p: F.when(acc["done"], acc)
        .when(p.rlike("^[A-Za-z]{4}$"), F.struct(F.lit(True).alias("done"), F.lower(p).alias("script")))
        .when(p.rlike(r"^[A-Za-z]{3}$"), acc)
        .otherwise(F.struct(F.lit(True).alias("done"), F.lit(None).cast("string").alias("script"))),
        lambda acc: acc["script"],
    )
    return before


def same_language(declared: Column, wanted: Column) -> Column:
    """PRJ-17: equal languages, and equal scripts where both declare one; regions don't matter."""
    a, b = script_subtag(declared), script_subtag(wanted)
    return (primary_subtag(declared) == primary_subtag(wanted)) & (a.isNull() | b.isNull() | (a == b))


def is_language_tag(tag: Column) -> Column:
    """PRJ-17."""
    return F.replace(strip(_or_empty(tag)), F.lit("_"), F.lit("-")).rlike(r"^[A-Za-z]{2,3}(?:-[A-Za-z0-9]{1,8})*$")


def han_convention(tag: Column) -> Column:
    """PRJ-17: JP, SC, TC or KR for a language tag, null for others."""
    parts = F.filter(F.split(F.replace(F.lower(strip(_or_empty(tag))), F.lit("_"), F.lit("-")), "-"), lambda p: p != "")
    first, rest = F.get(parts, F.lit(0)), F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))
    traditional = F.arrays_overlap(rest, F.array(*(F.lit(x) for x in ("hant", "tw", "hk", "mo"))))
    return (
        F.when(first.isin("ja", "jpn"), "JP")
        .when(first.isin("ko", "kor"), "KR")
        .when(first.isin("zh", "zho", "chi"), F.when(traditional, "TC").otherwise("SC"))
    )


def font_key(name: Column) -> Column:
    """PRJ-18: a font name without subset tag, spaces, hyphens, underscores and case."""
    return F.lower(F.regexp_replace(F.regexp_replace(_or_empty(name), r"^[A-Z]{6}\+", ""), r"[\s\-_]", ""))


def style_role(bold: Column, italic: Column) -> Column:
    """PRJ-19."""
    return F.when(bold & italic, "bold-italic").when(bold, "bold").when(italic, "italic").otherwise("regular")


def appearance_with_font(appearance: Column, font: Column) -> Column:
    """PRJ-20: the font name of a default appearance string replaced; size and colour operators stay."""
    return F.regexp_replace(appearance, F.lit(r"/\S+(\s+[-+]?[0-9.]+\s+Tf)"), F.concat(F.lit("/"), font, F.lit("$1")))


def leading_token(value: Column) -> Column:
    """PRJ-21: the first word before a comma or colon, without case."""
    return F.regexp_extract(casefold(strip(F.regexp_extract(_or_empty(value), r"^[^,:]*", 0))), r"^\S*", 0)


def pair_languages(pair: Column) -> Column:
    """PRJ-22: source and target of a language pair written with an arrow."""
    parts = F.split(_or_empty(pair), "->|→")
    return F.when(F.size(parts) == 2, F.struct(strip(F.get(parts, F.lit(0))).alias("source"), strip(F.get(parts, F.lit(1))).alias("target")))


def fitted_size(size: Column, width: Column, room: Column) -> Column:
    """PRJ-23: the size at which a run fits its room; never larger than the source's."""
    return F.when((width <= room) | (width <= 0), size).otherwise(size * F.greatest(room, F.lit(1.0)) / width)


def unit_direction(dx: Column, dy: Column) -> Column:
    """PRJ-9."""
    norm = F.hypot(dx, dy)
    return F.when(norm == 0, F.struct(F.lit(1.0).alias("x"), F.lit(0.0).alias("y"))).otherwise(F.struct((dx / norm).alias("x"), (dy / norm).alias("y")))


def is_rotated(dx: Column, dy: Column) -> Column:
    """PRJ-9."""
    return (F.abs(dx - 1) > 1e-6) | (F.abs(dy) > 1e-6)


def affine(m: list[Column], x: Column, y: Column) -> Column:
    """PRJ-8: a point through the matrix [a b c d e f]."""
    return F.struct((m[0] * x + m[2] * y + m[4]).alias("x"), (m[1] * x + m[3] * y + m[5]).alias("y"))


def composed(m: list[Column], n: list[Column]) -> list[Column]:
    """PRJ-10: the matrix that applies ``m``, then ``n``."""
    return [
        m[0] * n[0] + m[1] * n[2],
        m[0] * n[1] + m[1] * n[3],
        m[2] * n[0] + m[3] * n[2],
        m[2] * n[1] + m[3] * n[3],
        m[4] * n[0] + m[5] * n[2] + n[4],
        m[4] * n[1] + m[5] * n[3] + n[5],
    ]


def rgb(color: Column) -> Column:
    """PRJ-11: the parts of a packed sRGB colour, 0 to 1."""
    part = lambda bits: F.shiftright(color, bits).bitwiseAND(255) / F.lit(255.0)
    return F.struct(part(16).alias("r"), part(8).alias("g"), part(0).alias("b"))


def rgb_of_components(parts: Column) -> Column:
    """PRJ-11: gray, RGB or CMYK components as RGB."""
    at = lambda i: F.get(parts, F.lit(i))
    ink = lambda i: 1 - F.least(F.lit(1.0), at(i) + at(3))
    struct = lambda r, g, b: F.struct(r.alias("r"), g.alias("g"), b.alias("b"))
    return F.when(F.size(parts) == 1, struct(at(0), at(0), at(0))).when(F.size(parts) == 3, struct(at(0), at(1), at(2))).when(F.size(parts) == 4, struct(ink(0), ink(1), ink(2)))


