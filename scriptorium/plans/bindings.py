"""The driver's tables seen as the domain's: lines, segments with a made-up but fixed geometry, pairs, fields, pages.

Everything here is a projection of whole tables; the SQL beside each says the same for the comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import scripts as S
from scriptorium.operators import segments as seg
from scriptorium.tables import spread, table

LINES_A_PAGE = 12

#: What DuckDB's trim takes off: every space separator of Unicode, and no tab or control character.
SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"

#: Letters of Unicode 14 and 15, which DuckDB's \p{L} has and that of a Java 17 has not.
NEWER_LETTERS = (
    "870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7D0-A7D1 A7D3 A7D5-A7D9 A7F2-A7F4 10570-1057A"
    " 1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC 10780-10785 10787-107B0 107B2-107BA"
    " 10F70-10F81 11071-11072 11075 1123F-11240 11740-11746 11AB0-11ABF 11F02 11F04-11F10 11F12-11F33 12F90-12FF0 1342F 13441-13446"
    " 16A70-16ABE 1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD"
    " 1E4D0-1E4EB 1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 31350-323AF"
)
_LETTER = r"[\p{L}" + S.char_class(NEWER_LETTERS) + "]"

SQL_LINES = """lines AS (
  SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS line_no, unnest(l) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""

#: A line is its core; columns of three points apart, rows of 14 points, widths by length.
SQL_SEGMENTS = f"""{SQL_LINES}, segments AS (
  SELECT doc_id, line_no AS id, line_no // 12 AS page, trim(text) AS text, trim(text) AS core,
    CAST(72 + 3 * (length(text) % 3) AS DOUBLE) AS x0, CAST(14 * (line_no % 12) AS DOUBLE) AS y0,
    CAST(72 + 3 * (length(text) % 3) + 5 * length(trim(text)) AS DOUBLE) AS x1, CAST(14 * (line_no % 12) + 10 AS DOUBLE) AS y1,
    CAST(10 AS DOUBLE) AS size, NOT regexp_matches(trim(text), '[\\p{{L}}]') AS passthrough
  FROM lines)"""

SQL_PAIRS = """pairs AS (
  SELECT conv_id, turn, text AS core, lead(text) OVER w AS target, role, lead(role) OVER w AS next_role
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def without_letters(core: Column) -> Column:
    """What the SQL calls passthrough: wider than PRJ-4, which wants marks and most symbols beside digits translated."""
    return ~core.rlike(_LETTER)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.lines_of(spread(table(spark, sf_dir, "documents")))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = trimmed(F.col("text"))
    left = (F.lit(72) + 3 * (F.length("text") % 3)).cast("double")
    top = (14 * (F.col("line_no") % LINES_A_PAGE)).cast("double")
    return lines(spark, sf_dir).select(
        "doc_id",
        F.col("line_no").alias("id"),
        F.floor(F.col("line_no") / LINES_A_PAGE).cast("int").alias("page"),
        shown.alias("text"),
        shown.alias("core"),
        left.alias("x0"),
        top.alias("y0"),
        (left + 5 * F.length(shown)).alias("x1"),
        (top + 10).alias("y1"),
        left.alias("ox"),
        top.alias("oy"),
        F.lit(10.0).alias("size"),
        without_letters(shown).alias("passthrough"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn as the source and the answer after it as the target."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumn("target", F.lead("text").over(w)).withColumn("next_role", F.lead("role").over(w))
    return turns.filter("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("core"), "target")


def leader_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a parts list: marker, name, leader dots and a tail, by line item."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    items = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    dots = F.when(F.col("l_quantity") % 2 == 0, F.lit(" ........ $")).when(F.col("l_quantity") % 3 == 0, F.lit("       end")).otherwise(F.lit(""))
    return items.select("l_orderkey", "l_linenumber", F.concat(F.col("l_linenumber").cast("string"), F.lit(".  "), "p_name", dots).alias("text"))


SQL_LEADERS = """leaders AS (
  SELECT l_orderkey, l_linenumber, concat(l_linenumber, '.  ', p_name,
    CASE WHEN l_quantity % 2 = 0 THEN ' ........ $' WHEN l_quantity % 3 = 0 THEN '       end' ELSE '' END) AS text
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
