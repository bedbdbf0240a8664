"""Chat formatting: cumulative snapshots of a conversation collapse to the longest, which is then rendered.

A logger that stores the whole conversation after every turn leaves conversations that are prefixes of longer ones.
Each turn's rolling prefix hash names the conversation up to it: the exclusive or, over the turns so far, of 128 bits
hashed from position, role and text. A conversation whose last prefix hash is an inner prefix hash of another is a
snapshot of it. Equal conversations leave the one with the smallest id.

Only hashes take part in that search. Conversations and prefixes are made distinct by partial aggregates before they
meet in the anti-join, so a prefix that a third of all conversations share is one row on either side. The texts are
shuffled once, for the conversations that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turn_hash(salt: int) -> Column:
    text = [F.coalesce(F.col(c), F.lit("")) for c in ("role", "text")]
    return F.xxhash64(F.lit(salt), text[0], F.isnull("role"), text[1], F.isnull("text"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, n_turns, a, b) for each distinct turn: its place and the hash of all turns up to it."""
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "ha", "hb")
    so_far = by_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashed = turns.filter("conv_id is not null").select("conv_id", "turn", _turn_hash(1).alias("ha"), _turn_hash(2).alias("hb"))
    here = F.struct("turn", "ha", "hb")
    distinct = hashed.withColumn("again", here.eqNullSafe(F.lag(here).over(by_turn))).filter("not again").drop("again")
    placed = distinct.withColumn("place", F.row_number().over(by_turn))
    rolled = [F.bit_xor(F.xxhash64("place", h)).over(so_far).alias(name) for h, name in (("ha", "a"), ("hb", "b"))]
    return placed.select("conv_id", "place", F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("n_turns"), *rolled)


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies): conversations that are no prefix of a longer one, one of each group of equals."""
    prefixes = prefix_hashes(turns)
    whole = prefixes.filter("place = n_turns").groupBy("place", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    inner = prefixes.filter("place < n_turns").select("place", "a", "b").distinct()
    return whole.join(inner, ["place", "a", "b"], "left_anti").select("conv_id", F.col("place").cast("long").alias("n_turns"), "n_copies")


def _defused(text: Column) -> Column:
    """The text with the control strings broken up, so that no turn can open or close another."""
    return F.replace(F.replace(text, F.lit(OPEN), F.lit("<| im_start |>")), F.lit(CLOSE), F.lit("<| im_end |>"))


def rendered(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, chat) of each maximal conversation of ``turns`` (conv_id, turn, role, text).

    Defined cases: turns without conv_id belong to no conversation; exact repeats of a turn count once; turns that
    share a number follow each other by role and text; a null role is rendered as ``unknown`` and a null text as
    empty, yet both differ from these strings when conversations are compared; null turn numbers come first; an empty
    table gives an empty result; other columns are not read.
    """
    kept = maximal_conversations(turns)
    said = turns.select("conv_id", "turn", "role", "text").join(kept, "conv_id")
    line = lambda t: F.concat(F.lit(OPEN), _defused(F.coalesce(t["role"], F.lit("unknown"))), F.lit("\n"), _defused(F.coalesce(t["text"], F.lit(""))), F.lit(CLOSE + "\n"))
    gathered = said.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    ordered = F.sort_array(F.array_distinct("turns"))
    return gathered.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform(ordered, line), "").alias("chat"))
