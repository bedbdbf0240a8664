"""Page rasters as binary columns: dark pixels, changed channels, ink; Arrow batches into numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import constants as K
from scriptorium.functions.arrow import arrow_function


@arrow_function("long")
def dark_pixels(samples: pd.Series, channels: pd.Series) -> pd.Series:
    """AGG-11: pixels whose first channel is dark."""
    return pd.Series([int((np.frombuffer(s, np.uint8)[:: int(n)] < K.DARK_BELOW).sum()) if s is not None else None for s, n in zip(samples, channels)], dtype="Int64")


@arrow_function("long")
def changed_channels(a: pd.Series, b: pd.Series, delta: pd.Series) -> pd.Series:
    """AGG-11: channels of two rasters that differ by more than delta, over their common length."""

    def one(x: bytes | None, y: bytes | None, d: int) -> int | None:
        if x is None or y is None:
            return None
        n = min(len(x), len(y))
        return int((np.abs(np.frombuffer(x, np.uint8)[:n].astype(np.int16) - np.frombuffer(y, np.uint8)[:n]) > d).sum())

    return pd.Series([one(x, y, int(d)) for x, y, d in zip(a, b, delta)], dtype="Int64")


@arrow_function("double")
def difference_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """AGG-12: differing over all set bits of two bitmaps; 0 for two empty ones."""

    def one(x: bytes | None, y: bytes | None) -> float | None:
        if x is None or y is None:
            return None
        n = min(len(x), len(y))
        p, q = np.frombuffer(x, np.uint8)[:n], np.frombuffer(y, np.uint8)[:n]
        union = int(np.bitwise_count(p | q).sum())
        return int(np.bitwise_count(p ^ q).sum()) / union if union else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def ink_status(original: Column, output: Column) -> Column:
    """The ink gate: SKIP with too little ink, PASS inside the bounds of the ratio, else FAIL."""
    low, high = K.INK_RATIO
    return F.when(original < K.INK_SKIP, "SKIP").when((output / original).between(low, high), "PASS").otherwise("FAIL")


def unextractable(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page, text, ink) that show ink and yield no text."""
    return pages.filter((F.trim(F.coalesce("text", F.lit(""))) == "") & (F.col("ink") >= K.VISIBLE_INK)).select("doc_id", "page")


def invisible_pages(pages: DataFrame, least_share: float = 0.03) -> DataFrame:
    """Pages (doc_id, page, area, changed) whose text changes too few of the pixels under it to be visible."""
    share = F.bround(F.col("changed") / F.col("area"), 4)
    return pages.filter(F.col("area") > 0).withColumn("fraction", share).filter(F.col("fraction") < least_share).select("doc_id", "page", "fraction")


def shaping_verdict(codepoints: Column, naive: Column, shaped: Column, naive_font: Column, shaped_font: Column, expected_font: Column) -> Column:
    """The decision over a measured shaping probe: both arms in the expected face, one glyph a code point unshaped, and
    fewer when shaped."""
    key = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\-_]", ""))
    return (
        F.when(F.coalesce(expected_font, F.lit("")) == "", "FAIL")
        .when((key(naive_font) != key(expected_font)) | (key(shaped_font) != key(expected_font)), "FAIL")
        .when(naive != codepoints, "FAIL")
        .when(shaped >= naive, "FAIL")
        .otherwise("PASS")
    )


def face_verdict(own: Column, other: Column, probes: Column) -> Column:
    """The decision over measured glyph differences of a Han face: like its own convention, unlike the other one."""
    return F.when(probes < 2, "REVIEW").when((own <= 0.02) & (other >= 0.10), "PASS").when((own >= 0.10) & (other <= 0.02), "FAIL").otherwise("REVIEW")
