"""Lines of a page as stacks, and line-breaking rules of Chinese and Japanese text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import constants as K
from scriptorium.functions import scripts as S


def _stack_page(lines: pd.DataFrame) -> pd.DataFrame:
    lines = lines.sort_values(["y0", "x0", "line_no"], kind="stable")
    last: list[tuple[float, float, float]] = []  # right end of each stack's last line: x0, x1, y1
    sizes: list[int] = []
    stack, place = [], []
    for x0, y0, x1, y1 in lines[["x0", "y0", "x1", "y1"]].itertuples(index=False):
        height = y1 - y0
        for i, (px0, px1, py1) in enumerate(last):
            shared = min(x1, px1) - max(x0, px0)
            if shared >= 0.5 * min(x1 - x0, px1 - px0) and -0.5 * height <= y0 - py1 <= K.STACK_GAP * height:
                break
        else:
            i = len(last)
            last.append((x0, x1, y1))
            sizes.append(0)
        last[i] = (x0, x1, y1)
        stack.append(i)
        place.append(sizes[i])
        sizes[i] += 1
    return lines.assign(stack=stack, place=place)


def stacks(lines: DataFrame) -> DataFrame:
    """WIN-4: lines (doc_id, page, line_no, text, x0, y0, x1, y1) with the stack they belong to and their place in it.

    A line goes to the first stack whose last line it overlaps by half of the narrower width, closely below it. Each
    choice depends on the ones before, so a page is worked through in order; a page is small and pages are many.
    """
    wanted = lines.select("doc_id", "page", "line_no", "text", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema)
    return wanted.groupBy("doc_id", "page").applyInPandas(_stack_page, f"{kinds}, stack int, place int")


def page_line_order(lines: DataFrame) -> DataFrame:
    """SRT-3: lines (doc_id, page, line_no, x0, y0) with their place on the page: down it, then from left to right."""
    return lines.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "line_no")) - 1)


def kinsoku(stacked: DataFrame) -> DataFrame:
    """WIN-5: (doc_id, page, line_no, problem) lines that begin or end with a character their break forbids.

    Only stacks with a CJK letter are judged; single characters are values; a bullet that begins two or more lines of
    its stack is a list marker; the first line has no break before it and the last none after.
    """
    stack = Window.partitionBy("doc_id", "page", "stack")
    first, last = F.substring("text", 1, 1), F.right("text", F.lit(1))
    long = F.length("text") > 1
    bullets = [F.sum(F.when(long & (first == b), 1).otherwise(0)).over(stack) for b in K.KINSOKU_BULLETS]
    marker = F.lit(False)
    for b, n in zip(K.KINSOKU_BULLETS, bullets):
        marker = marker | ((first == b) & (n >= 2))
    judged = stacked.withColumn("_cjk", F.max(S.has_cjk(F.col("text"))).over(stack)).withColumn("_n", F.count(F.lit(1)).over(stack)).withColumn("_marker", marker)
    one_of = lambda c, chars: F.contains(F.lit(chars), c) & (c != "")
    ends = F.when((F.col("place") < F.col("_n") - 1) & one_of(last, K.KINSOKU_END), F.lit("line-end"))
    starts = F.when((F.col("place") > 0) & one_of(first, K.KINSOKU_START) & ~F.col("_marker"), F.lit("line-start"))
    problems = F.filter(F.array(ends, starts), lambda p: p.isNotNull())
    return judged.filter(F.col("_cjk") & long).select("doc_id", "page", "line_no", F.explode(problems).alias("problem"))


def judged_documents(stacked: DataFrame) -> DataFrame:
    """(doc_id) documents with a CJK line: the others have nothing to judge."""
    return stacked.filter(S.has_cjk(F.col("text"))).select("doc_id").distinct()
