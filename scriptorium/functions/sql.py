"""The text functions for Spark SQL: temporary SQL functions, which the optimizer inlines, and table functions.

    register(spark)
    spark.sql("select scr_number_tokens(text) from documents")
    spark.sql("select * from scr_write_find_say('see “Paid now” on Form A-1')")
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from scriptorium.functions import constants as K
from scriptorium.functions.text import EDGES, nfkc


def _raw(pattern: str) -> str:
    """A pattern as a raw SQL string literal; quotes are written as code points, which raw literals can't hold."""
    return "r'" + pattern.replace("'", r"\x27").replace('"', r"\x22") + "'"


def _in_text(value: str) -> str:
    return "'" + "".join(c if c.isalnum() or c in " -_./:" else f"\\u{ord(c):04x}" for c in value) + "'"


def _strip(expression: str) -> str:
    return f"regexp_replace({expression}, {_raw(EDGES)}, '')"


_T = "coalesce(t, '')"
_NO_DATES = f"regexp_replace({_T}, {_raw(K.DATE)}, ' ')"
#: name: (parameters, type, body)
SQL_FUNCTIONS = {
    "scr_normalize_ws": ("t STRING", "STRING", _strip(f"regexp_replace({_T}, {_raw(K.WRAP_SPACE)}, ' ')")),
    "scr_fold_drift": ("t STRING", "STRING", f"translate({_T}, {_in_text(K.FOLD_FROM)}, '{K.FOLD_TO}')"),
    "scr_casefold": ("t STRING", "STRING", "replace(lower(t), 'ß', 'ss')"),
    "scr_normalize_key": ("t STRING", "STRING", _strip(r"regexp_replace(replace(lower(regexp_replace(coalesce(t, ''), r'\p{P}', '')), 'ß', 'ss'), r'\s+', ' ')")),
    "scr_strip_dates": ("t STRING", "STRING", _NO_DATES),
    "scr_number_tokens": ("t STRING", "ARRAY<STRING>", f"array_sort(transform(regexp_extract_all({_T}, {_raw(K.NUMBER)}, 0), x -> regexp_replace(regexp_replace(x, r'\\P{{Nd}}', ''), '^0+(?=.)', '')))"),
    "scr_date_parts": ("t STRING", "ARRAY<STRING>", f"transform(regexp_extract_all({_T}, {_raw(K.DATE)}, 0), d -> array_join(array_sort(transform(split(d, r'[./\\-]'), x -> regexp_replace(x, '^0+(?=.)', ''))), '|'))"),
    "scr_is_passthrough": ("t STRING", "BOOLEAN", f"t = '' OR t RLIKE {_raw(K.PASSTHROUGH)}"),
    "scr_has_inner_gap": ("t STRING", "BOOLEAN", f"t RLIKE {_raw(K.INNER_GAP)}"),
    "scr_strip_markup": ("t STRING", "STRING", f"regexp_replace({_T}, {_raw(K.INLINE_TAGS)}, '')"),
    "scr_html_plain": ("t STRING", "STRING", rf"regexp_replace(regexp_replace({_T}, r'(?i)<br\s*/?>', ' '), '<[^>]+>', '')"),
    "scr_marker": ("t STRING", "STRING", _strip(f"regexp_extract(t, {_raw(K.MARKER)}, 0)")),
    "scr_expansion_limit": ("n INT", "DOUBLE", "CASE " + " ".join(f"WHEN n <= {a} THEN {b}D" for a, b in K.EXPANSION_BANDS) + f" ELSE {K.EXPANSION_BANDS[-1][1]}D END"),
    "scr_font_key": ("t STRING", "STRING", r"lower(regexp_replace(regexp_replace(coalesce(t, ''), r'^[A-Z]{6}\+', ''), r'[\s\-_]', ''))"),
    "scr_leading_token": ("t STRING", "STRING", "regexp_extract(replace(lower(" + _strip(f"regexp_extract({_T}, '^[^,:]*', 0)") + "), 'ß', 'ss'), r'^\\S*', 0)"),
    "scr_primary_subtag": ("t STRING", "STRING", f"lower(split_part({_strip(_T)}, '-', 1))"),
}


@udtf(returnType="kind: string, snippet: string")
class WriteFindSay:
    """PRJ-6 as a table function: one row a hit."""

    def eval(self, text: str):
        for kind, pattern, group in (("quoted", K.QUOTED, 1), ("form-name", K.FORM_NAME, 1), ("url-or-email", K.URL_EMAIL, 1)):
            for hit in re.finditer(pattern, text or ""):
                yield kind, hit[group]


@udtf(returnType="start: int, run: string, bucket: string")
class ScanLeaks:
    """WIN-6 as a table function: islands of words of a text that are source words (comma-separated, lower case)."""

    def eval(self, text: str, words: str):
        known = {w.strip() for w in (words or "").split(",") if w.strip()}
        island: list[str] = []
        start = 0
        for place, token in enumerate([*re.findall(r"[A-Za-z][A-Za-z'\-]*", text or ""), ""]):
            if token.lower() in known:
                start = start if island else place
                island.append(token)
            elif island:
                yield start, " ".join(island), "running" if len(island) >= 3 else "isolated"
                island = []


def register(spark: SparkSession) -> list[str]:
    """Make all functions callable in the session's SQL; their names."""
    for name, (parameters, returns, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
    spark.udf.register("scr_nfkc", nfkc.udf())
    spark.udtf.register("scr_write_find_say", WriteFindSay)
    spark.udtf.register("scr_scan_leaks", ScanLeaks)
    return [*SQL_FUNCTIONS, "scr_nfkc", "scr_write_find_say", "scr_scan_leaks"]
