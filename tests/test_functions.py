"""Text and script functions on golden rows and against plain Python."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import constants as K
from scriptorium.functions import scripts as S
from scriptorium.functions import text as T


def values(spark, rows, *columns, schema="text string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [tuple(r) if len(r) > 1 else r[0] for r in df.select(*columns).collect()]


def test_numbers(spark):
    assert values(spark, ["Pay $1,250.00 now", "1.250,00", "no digits", "007 and 0", None], T.number_tokens(F.col("text"))) == [["125000"], ["125000"], [], ["0", "7"], []]


def test_dates(spark):
    assert values(spark, ["12/31/2024", "due 1.2.03 or 04-05-06"], T.date_parts(F.col("text"))) == [["12|2024|31"], ["1|2|3", "4|5|6"]]
    assert values(spark, ["due 12/31/2024 ok"], T.strip_dates(F.col("text"))) == ["due   ok"]


def test_pairs_and_limits(spark):
    assert values(spark, ["a (b", "a (b)", 'say "hi', "«x", None], T.unbalanced_pairs(F.col("text"))) == [["()"], [], ['""'], ["«»"], []]
    limits = values(spark, [(4,), (10,), (11,), (60,), (500,)], T.expansion_limit(F.col("n")), schema="n int")
    assert limits == [3.0, 3.0, 2.0, 1.4, 1.3]


def test_keys(spark):
    assert len(set(values(spark, ["State:", "state", "ＳＴＡＴＥ"], T.normalize_key(F.col("text"), T.nfkc)))) == 1
    assert values(spark, ["Straße"], T.casefold(F.col("text"))) == ["strasse"]
    assert values(spark, ["FL-100 “Petition—Marriage/Domestic”"], T.run_key(F.col("text"))) == ["petition marriage domestic"]
    assert values(spark, ["東京 都"], T.run_key(F.col("text"), "CJK")) == ["東京都"]


def test_parts(spark):
    lead = T.leader_parts(T.without_marker(F.col("text")))
    rows = values(spark, ["a.  Rent ........ $", "(12) Total", "3.", "plain", "…… $"], T.marker(F.col("text")), T.marker_gap(F.col("text")), lead["core"], lead["dots"], lead["tail"])
    assert rows[0] == ("a.", "  ", "Rent", "........", "$")
    assert rows[1] == ("(12)", " ", "Total", "", "")
    assert rows[2][0] == "3." and rows[2][2] == ""
    assert rows[3][0] == "" and rows[3][2] == "plain"


def test_passthrough(spark):
    assert values(spark, ["", "12.50 $", "—", "may", "é", "№ 5"], T.is_passthrough(F.col("text"))) == [True, True, True, False, False, False]


def test_hits(spark):
    found = values(spark, ['write “Paid in full” on Form FL-150, see https://a.b/c or me@x.org'], T.write_find_say(F.col("text")))[0]
    assert [(h["kind"], h["snippet"]) for h in found] == [("quoted", "Paid in full"), ("form-name", "Form FL-150"), ("url-or-email", "https://a.b/c"), ("url-or-email", "me@x.org")]


def test_language_tags(spark):
    tags = ["es-US", "zh-Hant-TW", "ja", "zh_CN", "sr-x-latn", "", "Japanese"]
    t = F.col("text")
    rows = values(spark, tags, T.primary_subtag(t), T.script_subtag(t), T.is_language_tag(t), T.han_convention(t))
    assert rows[0] == ("es", None, True, None)
    assert rows[1] == ("zh", "hant", True, "TC")
    assert rows[2][3] == "JP" and rows[3][3] == "SC" and rows[4][1] is None
    assert rows[5][2] is False and rows[6][2] is False


@pytest.mark.parametrize(("text", "script"), [("Привет мир", "Cyrillic"), ("abc где", "Latin"), ("где abc", "Cyrillic"), ("日本語 an", "CJK"), ("12 !", None), ("שלום", "Hebrew"), ("नमस्ते", "Devanagari"), (None, None)])
def test_dominant_script(spark, text, script):
    assert values(spark, [text], S.dominant_script(F.col("text"))) == [script]


def test_script_counts_against_plain_python(spark):
    r = random.Random(48)
    texts = ["".join(chr(r.choice([r.randrange(32, 0x600), r.randrange(0x900, 0x1100), r.randrange(0x3040, 0x3100), r.randrange(0x4E00, 0x9FFF)])) for _ in range(60)) for _ in range(40)]

    def plain(text):
        out = {}
        for c in text:
            if unicodedata.category(c).startswith("L"):
                name = next((n for n, ranges in K.SCRIPT_RANGES.items() if any(a <= ord(c) <= b for a, b in S.ranges(ranges))), None)
                if name:
                    out[name] = out.get(name, 0) + 1
        return max(out, key=out.get) if out else None

    assert values(spark, texts, S.dominant_script(F.col("text"))) == [plain(t) for t in texts]


def test_target_script(spark):
    rows = [("Hello there\nПривет мир\nкак дела", "Hello there\nold words"), ("Hello there", "Hello there")]
    assert values(spark, rows, S.target_script(F.col("o"), F.col("s")), schema="o string, s string") == ["Cyrillic", None]


def test_tells(spark):
    rows = [("ひらがな", "SC"), ("漢字", "JP"), ("汉", "JP"), ("漢", "SC"), ("abc", "TC"), ("漢", "KR")]
    assert values(spark, rows, S.tells("t", "c"), schema="t string, c string") == [list("ひらがな"), [], ["汉"], ["漢"], [], []]
    assert values(spark, ["ひらがな", "汉", "一", None], S.convention_of("text")) == ["JP", "SC", None, None]


def test_predicates(spark):
    t = F.col("text")
    assert values(spark, ["ไทย", "नम", "abc", "السلام"], S.has_spaceless_script(t), S.needs_shaping(t), S.is_rtl(t)) == [(True, True, False), (False, True, False), (False, False, False), (False, True, True)]
    assert values(spark, ["a\u0007", "plain é", "x​"], S.is_plain_text(t)) == [False, True, False]
    assert values(spark, ["Foo bar FOO"], S.without_allowed(t, ["foo", "foo bar"])) == [" "]


def test_markup(spark):
    t = F.col("text")
    assert values(spark, ["<b>x</b><i >y</EM>"], T.strip_inline_markup(t)) == ["xy"]
    assert values(spark, ["a<br/>b<p>c</p>"], T.html_plain(t)) == ["a bc"]
    assert values(spark, ["1 < 2 & <b>x</b>"], T.escape_keeping(t)) == ["1 &lt; 2 &amp; <b>x</b>"]
    assert values(spark, ["Accepted with a different fix: x", "rejected, y", None], T.leading_token(t)) == ["accepted", "rejected", ""]


def test_geometry_functions(spark):
    row = spark.range(1).select(T.fitted_size(F.lit(10.0), F.lit(20.0), F.lit(10.0)).alias("a"), T.fitted_size(F.lit(10.0), F.lit(5.0), F.lit(10.0)).alias("b"), T.is_rotated(F.lit(0.0), F.lit(1.0)).alias("c"), T.rgb(F.lit(0xFF8000)).alias("d")).first()
    assert (row["a"], row["b"], row["c"], row["d"]["r"], row["d"]["b"]) == (5.0, 10.0, True, 1.0, 0.0)


def test_plain_text_repertoire(spark):
    """Against a loop over categories and names, for every letter, number, mark and symbol of the first planes."""
    cjk = [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x2FA1F)]

    def plain(c):
        kind, code = unicodedata.category(c), ord(c)
        if c == "‖" or kind[0] in "MC" or (kind == "So" and code >= 0x1F000):
            return False
        if kind[0] == "L":
            return "LATIN" in unicodedata.name(c, "") or c == "々" or any(a <= code <= b for a, b in cjk)
        return kind[0] != "N" or c in "0123456789０１２３４５６７８９"

    chars = [chr(c) for c in [*range(0x3400), *range(0xA000, 0xD800, 7), *range(0xF900, 0x11000), *range(0x1F000, 0x1F700)] if unicodedata.category(chr(c)) != "Cn"]
    rows = values(spark, chars, S.is_plain_text(F.col("text")), F.col("text").rlike(r"\p{Cn}"))
    assert [c for c, (ok, unknown) in zip(chars, rows) if ok != (plain(c) and not unknown)] == []
    assert sum(unknown for _, unknown in rows) < len(rows) / 50
