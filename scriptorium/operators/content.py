"""Content streams: text objects removed, graphics state walked, logical text decoded; Flate data by the standard
library, as there is no renderer here."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.arrow import arrow_function



def in_name_order(objects: Column) -> Column:
    """SRT-5: a map of named objects as entries sorted by name, so that every walk over them is the same."""
    return F.array_sort(F.map_entries(objects))


#: Fixed value: operators that show or place text, which go with their text object.
TEXT_OPERATORS = "Tc Tw Tz TL Tf Tr Ts Td TD Tm T* Tj TJ ' \"".split()
_TOKEN = re.compile(rb"%[^\r\n]*|\((?:\\.|[^()\\]|\((?:\\.|[^()\\])*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|[\[\]{}]|/[^\s()<>\[\]{}/%]*|[^\s()<>\[\]{}/%]+", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)


def stripped_ops(ops: DataFrame) -> DataFrame:
    """WIN-13: operators (doc_id, stream, pos, op, ...) without text objects and the text operators in them; what else
    stands in a text object stays, as its state outlives it.

    The depth is the running balance of BT and ET that never falls below zero: the sum less its least value so far.
    """
    order = Window.partitionBy("doc_id", "stream").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("op") == "BT", 1).when(F.col("op") == "ET", -1).otherwise(0)
    walked = ops.withColumn("_sum", F.sum(step).over(order))
    depth = F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(order))
    return walked.withColumn("_depth", depth).filter(~F.col("op").isin("BT", "ET") & ~((F.col("_depth") > 0) & F.col("op").isin(*TEXT_OPERATORS))).drop("_sum", "_depth")


def parsed(data: bytes) -> Iterator[tuple[list[str], str]]:
    """(operands, operator) of a content stream in order."""
    operands: list[str] = []
    depth = 0
    for token in _TOKEN.findall(data):
        text = token.decode("latin-1")
        if text[0] == "%":
            continue
        if text in ("[", "<<"):
            depth += 1
        elif text in ("]", ">>"):
            depth -= 1
        if depth or text[0] in "(</[]>" or re.fullmatch(r"[-+.0-9]+|true|false|null", text):
            operands.append(text)
        else:
            yield operands, text
            operands = []


@arrow_function("array<struct<operands:array<string>,op:string>>")
def operators(content: pd.Series) -> pd.Series:
    """The operators of content streams."""
    return pd.Series([[{"operands": o, "op": p} for o, p in parsed(bytes(c or b""))] for c in content])


@arrow_function("array<binary>")
def flate_streams(file: pd.Series) -> pd.Series:
    """The streams of a PDF file, inflated where they are Flate data."""

    def one(data: bytes | None) -> list[bytes]:
        out = []
        for raw in _STREAM.findall(bytes(data or b"")):
            try:
                out.append(zlib.decompress(raw))
            except zlib.error:
                out.append(raw)
        return out

    return file.map(one)


@arrow_function("array<struct<op:string,a:double,b:double,c:double,d:double,e:double,f:double,mode:int>>")
def shown_text_states(content: pd.Series) -> pd.Series:
    """WIN-12: for every text-showing operator the matrix in force (text times transformation) and the render mode,
    with the state pushed and popped by q and Q."""

    def times(m: tuple, n: tuple) -> tuple:
        return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])

    def one(data: bytes | None) -> list[dict]:
        unit = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
        ctm, tm, line, mode, held, out, leading = unit, unit, unit, 0, [], [], 0.0
        for operands, op in parsed(bytes(data or b"")):
            try:
                numbers = tuple(float(x) for x in operands)
            except ValueError:
                numbers = ()
            if op == "q":
                held.append((ctm, mode, leading))
            elif op == "Q" and held:
                ctm, mode, leading = held.pop()
            elif op == "cm" and len(numbers) == 6:
                ctm = times(numbers, ctm)
            elif op == "BT":
                tm = line = unit
            elif op == "Tm" and len(numbers) == 6:
                tm = line = numbers
            elif op in ("Td", "TD") and len(numbers) == 2:
                leading = -numbers[1] if op == "TD" else leading
                tm = line = times((1.0, 0.0, 0.0, 1.0, *numbers), line)
            elif op == "TL" and numbers:
                leading = numbers[0]
            elif op in ("T*", "'", '"'):
                tm = line = times((1.0, 0.0, 0.0, 1.0, 0.0, -leading), line)
            elif op == "Tr" and numbers:
                mode = int(numbers[0])
            if op in ("Tj", "TJ", "'", '"'):
                out.append(dict(zip("abcdef", times(tm, ctm)), op=op, mode=mode))
        return out

    return content.map(one)


def actual_texts(content: Column) -> Column:
    """SRC-4: the logical strings of marked content: hexadecimal UTF-16 with or without a byte order mark."""
    found = F.regexp_extract_all(content, F.lit(r"/ActualText\s*<\s*([0-9A-Fa-f]+)\s*>"), F.lit(1))

    def decoded(h: Column) -> Column:
        up = F.upper(h)
        little = F.decode(F.unhex(F.substr(up, F.lit(5))), "UTF-16LE")
        return F.when(up.startswith("FEFF"), F.decode(F.unhex(F.substr(up, F.lit(5))), "UTF-16BE")).when(up.startswith("FFFE"), little).otherwise(F.decode(F.unhex(up), "UTF-16BE"))

    return F.transform(found, decoded)


def search_text(text: Column, content: Column) -> Column:
    """SRC-3: a page's text and its logical strings."""
    return F.concat_ws("\n", F.coalesce(text, F.lit("")), F.array_join(actual_texts(content), "\n"))
