"""Personal data by patterns, checksums and context, in native expressions.

Patterns propose spans, checksum validators (Luhn, mod 97) confirm them, and words nearby, before and after a span,
raise or lower its score; a span below the threshold is dropped. The base kinds are an exception: their contract keeps
every valid match. All positions are code points, end exclusive.

Positions come from splitting a text at a pattern's matches: the running sums of the lengths of the pieces between, and
of the matches. Only texts in which a pattern occurs are split. Nothing here is quadratic in a long text: running sums
are made by doubling steps, stretches of the text are cut out of an array of equal pieces instead of being counted off
from its beginning, runs in patterns are possessive, groups repeat possessively (the regex engine then loops instead
of recursing), and a look-behind starts them at a run's first character, where the leftmost match is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.native import columns_of, fresh, let, quoted, with_text

#: How much a context word nearby adds to a score or takes from it, and how far before and after a span it is looked
#: for, in code points.
CONTEXT_GAIN = 0.35
CHARS_BEFORE = 48
CHARS_AFTER = 32
THRESHOLD = 0.7
_PIECE = 256


@dataclass(frozen=True)
class Kind:
    """One kind of personal data: pattern, validator name, score with a passed validator, words before and after that
    raise it, words on either side that lower it, a class of characters that may not touch a span, base or not, and a
    string that every match has, which is looked for first."""

    name: str
    pattern: str
    validator: str = "none"
    score: float = 1.0
    before: str = ""
    after: str = ""
    against: str = ""
    edge: str = ""
    base: bool = False
    needs: str = ""


_LOCAL = "A-Za-z0-9._%+-"
#: Lengths of international account numbers, by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS",
    23: "AE GI IL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC SM", 28: "AL AZ CY DO GT HU LB PL", 29: "BR PS", 30: "JO KW MU", 31: "MT",
}
IBAN = "|".join(f"(?:{'|'.join(names.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{size - 4}}}" for size, names in IBAN_LENGTHS.items())
_SSN = "(?i)ssn|social security|tax id"
#: The beginnings of access keys that their issuers mark so, and the lengths after them.
KEY = "(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|(?:sk|rk)_live_[A-Za-z0-9]{24}|xox[abprs]-[A-Za-z0-9-]{20}|AIza[A-Za-z0-9_-]{35}"
#: Kinds in the order in which spans that start together are listed. The first four always count once valid.
KINDS = (
    Kind("email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", base=True, needs="@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "octets", base=True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){13,}+", "card", base=True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "phone", base=True, needs="+"),
    Kind("iban", f"(?=[A-Z]{{2}}[0-9]{{2}})(?:{IBAN})", "iban", 0.9, "(?i)iban|account|konto|compte|cuenta", "(?i)iban|account|konto|compte|cuenta", "(?i)example|sample|dummy"),
    Kind("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "ssn", 0.45, _SSN, _SSN, "(?i)part|order|serial|invoice|isbn|phone|fax", "[0-9-]"),
    Kind("secret", "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+", "mixed", 0.45, "(?i)(?:token|secret|api[ _-]?key|password|passwd|credential)s?[\"']?\\s*(?:[:=]|\\sis\\s)\\s*[\"']?$|(?i)bearer\\s+$", "", "(?i)checksum|md5|sha-?(?:1|256|512)|commit|digest"),
    Kind("key", KEY, "none", 0.9, "(?i)key|token|secret", "(?i)key|token|secret", "(?i)example|sample|dummy", "[A-Za-z0-9]"),
    Kind("private_key", "-----BEGIN (?:[A-Z0-9]+ )?PRIVATE KEY-----[A-Za-z0-9+/=:,\\s]*+-----END (?:[A-Z0-9]+ )?PRIVATE KEY-----", "none", 0.95, needs="PRIVATE KEY-----"),
)
_LEAST_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _mod97(value: Column) -> Column:
    """The remainder by 97 of an account number: its first four characters moved to the end, letters as 10 to 35."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))

    def fold(t: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            code = F.ascii(F.substr(t, i, F.lit(1)))
            return F.when(code < 65, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

        return F.aggregate(F.sequence(F.lit(1), F.length(t)), F.lit(0), step)

    return let(turned, fold)


def valid(kind: Kind, value: Column) -> Column:
    """Whether a match of the kind's pattern passes its validator."""
    if kind.validator == "octets":
        return value.rlike(rf"^{_LEAST_OCTET}(?:\.{_LEAST_OCTET}){{3}}$")
    if kind.validator == "card":
        return let(_digits(value), lambda d: F.length(d).between(14, 19) & F.call_function("luhn_check", d))
    if kind.validator == "phone":
        return F.length(_digits(value)).between(10, 15)
    if kind.validator == "iban":
        return _mod97(value) == 1
    if kind.validator == "ssn":
        return ~value.rlike("^(?:000|666|9[0-9]{2})|-00-|-0000$")
    if kind.validator == "mixed":
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return F.lit(True)


_SPANS = "array<struct<start:int,ord:int,end:int,kind:string,score:double>>"


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """``join`` of all values up to each place of an array that is not empty, by doubling steps: n log n."""

    def step(acc: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda x, i: F.when(i >= back, join(x, F.get(acc, i - back))).otherwise(x))

    return F.aggregate(F.sequence(F.lit(0), F.floor(F.log2(F.size(values))).cast("int")), values, step)


def in_pieces(text: Column) -> Column:
    """The text as an array of pieces of equal length, the last one shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """The characters from start to end of a text in pieces; the time depends on their number, not on the place."""
    first = F.floor(start / _PIECE).cast("int")
    count = F.floor((end + (_PIECE - 1)) / _PIECE).cast("int") - first
    return F.substr(F.array_join(F.slice(pieces, first + 1, F.greatest(count, F.lit(0))), ""), start - first * _PIECE + 1, end - start)


def _scored(kind: Kind, pieces: Column, found: Column) -> Column:
    """The matches with their scores, changed by the words nearby; without those that another character touches."""
    if kind.edge:
        touched = lambda x: cut(pieces, F.greatest(x["start"] - 1, F.lit(0)), x["start"]).rlike(kind.edge) | cut(pieces, x["end"], x["end"] + 1).rlike(kind.edge)
        found = F.filter(found, lambda x: ~touched(x))

    def score(x: Column) -> Column:
        sides = (cut(pieces, F.greatest(x["start"] - CHARS_BEFORE, F.lit(0)), x["start"]), cut(pieces, x["end"], x["end"] + CHARS_AFTER))

        def any_of(*patterns: str) -> Column:
            return reduce(lambda a, b: a | b, (side.rlike(p) for side, p in zip(sides, patterns) if p), F.lit(False))

        raised = F.when(any_of(kind.before, kind.after), F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0))
        lowered = F.when(any_of(kind.against, kind.against), F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0))
        return F.least(F.lit(1.0), F.lit(kind.score) + raised - lowered)

    return F.transform(found, lambda x: x.withField("score", score(x)))


def _spans_of(text: Column, ordinal: int, kind: Kind) -> Column:
    none = F.array().cast(_SPANS)

    def placed(gaps: Column, matches: Column) -> Column:
        widths = F.transform(matches, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
        return let(running(widths, lambda a, b: a + b), lambda ends: F.transform(matches, lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("value"), F.lit(kind.score).alias("score"))))

    def spans(found: Column) -> Column:
        valid_ones = F.filter(found, lambda x: valid(kind, x["value"]))
        if not kind.base and (kind.edge or kind.before or kind.after or kind.against):
            valid_ones = let(in_pieces(text), lambda pieces: _scored(kind, pieces, valid_ones))
        told = F.filter(valid_ones, lambda x: x["score"] >= THRESHOLD)
        return F.transform(told, lambda x: F.struct(x["start"].alias("start"), F.lit(ordinal).alias("ord"), x["end"].alias("end"), F.lit(kind.name).alias("kind"), x["score"].alias("score"))).cast(_SPANS)

    gaps, matches = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    there = F.contains(text, F.lit(kind.needs)) & text.rlike(kind.pattern) if kind.needs else text.rlike(kind.pattern)
    return F.when(there, let(gaps, lambda p: let(matches, lambda m: spans(placed(p, m))))).otherwise(none)


def with_spans(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, name: str = "pii_spans") -> DataFrame:
    """``docs`` (with text) plus the column ``name``: all spans by start, then kind as listed; (start, ord, end, kind, score).

    Spans of different kinds may overlap, and two of different kinds that start together are listed in the kinds'
    order. Defined cases: a null or empty text has no spans; repeated rows have the same spans; an empty table gives
    an empty result; a column of that name, in any case, is replaced, others are carried along whatever their names;
    every row is searched by itself, whole, in time n log n of its length; bytes that are not UTF-8 count as
    replacement characters.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    each = [_spans_of(text, i, k) for i, k in enumerate(kinds)]
    return docs.select(*columns_of(docs, without=[name]), F.sort_array(F.concat(*each)).alias(name))


def spans_text(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted_text(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one replacement."""

    def over(pieces: Column, ends: Column) -> Column:
        seen = F.transform(spans, lambda s, i: F.struct(F.coalesce(F.get(ends, i - 1), F.lit(0)).alias("at"), s["start"].alias("start"), s["kind"].alias("kind")))
        opened = F.filter(seen, lambda s: s["start"] >= s["at"])
        marked = F.transform(opened, lambda s: F.concat(cut(pieces, s["at"], s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        return F.concat(F.array_join(marked, ""), cut(pieces, F.element_at(ends, -1), F.length(text)))

    reach = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    return F.when(F.size(spans) == 0, text).otherwise(let(in_pieces(text), lambda pieces: let(reach, lambda ends: over(pieces, ends))))


def redacted(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` and ``n_chars``, if present, brought up to date.

    The cases are those of ``with_spans``; a null text stays null.
    """
    spans = fresh(docs, "pii_spans")
    found = with_spans(docs, kinds, spans)
    changed = with_text(found, redacted_text(F.col("text"), F.col(spans)))
    return changed.select(*(F.col(quoted(c)) for c in docs.columns))


def count_of(spans: Column, name: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == name)).cast("long")


def base_spans(spans: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """The spans of the base kinds."""
    names = [k.name for k in kinds if k.base]
    return F.filter(spans, lambda s: reduce(lambda a, b: a | b, (s["kind"] == n for n in names)))
