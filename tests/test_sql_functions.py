"""SQL functions give what the column functions give."""

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import sql
from scriptorium.functions import text as T

TEXTS = ["Pay $1,250.00 by 12/31/2024.", "", "a.  Rent ...... $", "It's “Straße”\n x", "<b>x</b><br/>y", "12.50 $", "ABCDEF+Noto Sans-Bold", "Rejected, twice", "zh-Hant-TW", "a      b", "l’été 007", None, " x­q"]
SAME = {
    "scr_normalize_ws": T.normalize_ws, "scr_fold_drift": T.fold_drift, "scr_casefold": T.casefold, "scr_normalize_key": T.normalize_key, "scr_strip_dates": T.strip_dates, "scr_number_tokens": T.number_tokens, "scr_date_parts": T.date_parts,
    "scr_is_passthrough": T.is_passthrough, "scr_has_inner_gap": T.has_inner_gap, "scr_strip_markup": T.strip_inline_markup, "scr_html_plain": T.html_plain, "scr_marker": T.marker, "scr_font_key": T.font_key,
    "scr_leading_token": T.leading_token, "scr_primary_subtag": T.primary_subtag,
}


@pytest.fixture(scope="module")
def names(spark):
    return sql.register(spark)


@pytest.mark.parametrize("name", sorted(SAME))
def test_scalar(spark, names, name):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    rows = df.select(F.expr(f"{name}(t)").alias("a"), SAME[name](F.col("t")).alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows]


def test_inlined(spark, names):
    plan = spark.range(3).selectExpr("scr_expansion_limit(cast(id as int)) x")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert spark.sql("select scr_expansion_limit(11), scr_expansion_limit(500)").first()[:] == (2.0, 1.3)


def test_table_functions(spark, names):
    assert [tuple(r) for r in spark.sql("select * from scr_write_find_say('see “Paid now” on Form A-1')").collect()] == [("quoted", "Paid now"), ("form-name", "Form A-1")]
    rows = spark.sql("select * from scr_scan_leaks('Rent schedule plan bleibt; Rent', 'rent,schedule,plan')").collect()
    assert [tuple(r) for r in rows] == [(0, "Rent schedule plan", "running"), (4, "Rent", "isolated")]
