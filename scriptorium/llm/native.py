"""Helpers for expressions that stay inside the JVM, and for column names of any kind."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it.

    The optimizer may inline a projected column into each of its uses; a lambda variable is always bound to a value.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text, an empty array for a null or wordless one."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WORD_GAP)))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, without regard to case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    """A column name as it must be written where it may hold dots or backticks."""
    return f"`{name.replace('`', '``')}`"


def columns_of(df: DataFrame, without: Iterable[str] = ()) -> list[Column]:
    """The columns of ``df`` whatever their names, but for those named in ``without`` (without regard to case)."""
    left_out = {w.lower() for w in without}
    return [F.col(quoted(c)) for c in df.columns if c.lower() not in left_out]


def with_text(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with ``text`` in place of its text and, if there is one, n_chars brought up to date.

    Two projections: in one, the name text inside the length would be taken for the new column.
    """
    changed = df.select(*(text.alias(c) if c.lower() == "text" else F.col(quoted(c)) for c in df.columns))
    return changed.select(*(F.length("text").cast("long").alias(c) if c.lower() == "n_chars" else F.col(quoted(c)) for c in df.columns))
