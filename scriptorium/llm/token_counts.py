"""Token counts by a two-tier lookup on the map side.

First tier: a compact table of frequent pre-tokens and their lengths in tokens, broadcast once. Which pre-tokens are
frequent is measured on a sample drawn from all documents alike, of about ``SAMPLE_ROWS`` rows whatever the corpus;
only the counts of that sample are exchanged. Second tier: pre-tokens that miss the table are merged by the worker that
meets them and kept in its cache, which is bounded in bytes. No pre-token of the corpus is shuffled, and the counts do
not depend on the tiers: the sample decides what is looked up, never what is counted.

A special token's string inside a text counts as that one token, and the text before and after it is split apart.
"""

from __future__ import annotations

import json
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.bpe import CACHE_BYTES, PIECE_BYTES, Merges, merges_of_json, vocabulary
from scriptorium.llm.pretokens import BYTE_LEVEL, in_portions, splitter

#: About how many documents the frequent pre-tokens are measured on, and how many of these the table holds.
SAMPLE_ROWS = 10_000
TABLE_ENTRIES = 1 << 15
_SEED = 7


@lru_cache(maxsize=4)
def special_strings(data: bytes) -> tuple[str, ...]:
    """The strings of a vocabulary file's added tokens, longest first; they match verbatim, wherever they stand."""
    added = json.loads(data)["added_tokens"]
    for token in added:
        if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
            raise ValueError(f"added token {token['content']!r} does not match verbatim")
    return tuple(sorted((t["content"] for t in added), key=len, reverse=True))


def pieces_of(specials: tuple[str, ...], pattern: str) -> Callable[[str], tuple[int, list[str]]]:
    """A function that tells how many special strings a text has and lists the pre-tokens of the rest."""
    split = splitter(pattern)
    cut = regex.compile("|".join(map(regex.escape, specials))).split if specials else None

    def pieces(text: str) -> tuple[int, list[str]]:
        if cut and any(s in text for s in specials):
            parts = cut(text)
            return len(parts) - 1, [p for part in parts for p in split(part)]
        return 0, split(text)

    return pieces


def frequent_pretokens(docs: DataFrame, specials: tuple[str, ...] = (), pattern: str = BYTE_LEVEL, sample_rows: int = SAMPLE_ROWS, entries: int = TABLE_ENTRIES) -> tuple[list[str], float]:
    """The most frequent pre-tokens of ``docs`` (text), most frequent first, and the share of the sample's that they are.

    Measured on all rows if there are no more than ``sample_rows``, else on a random sample of about as many. Ties go
    to the smaller string. Pre-tokens with a NUL, which separates the table's entries, are left out.
    """
    rows = docs.count()
    texts = docs.select(F.make_valid_utf8("text").alias("text"))
    sample = texts if rows <= sample_rows else texts.sample(fraction=sample_rows / rows, seed=_SEED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, counts = pieces_of(specials, pattern), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(pieces(text or "")[1])
        rows = [(None, counts.total()), *((p, n) for p, n in counts.items() if "\0" not in p)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["piece", "n"])

    # the null piece is the number of all
    counted = sample.mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    found = counted.orderBy(F.isnotnull("piece"), F.desc("n"), "piece").limit(entries + 1).collect()
    total = found[0]["n"] if found else 0
    return [r["piece"] for r in found[1:]], (sum(r["n"] for r in found[1:]) / total if total else 0.0)


def lengths_table(words: list[str], merges: Merges) -> tuple[str, bytes]:
    """The compact table: the words joined by NUL, and their numbers of tokens as 32-bit integers."""
    return "\0".join(words), array("I", (len(ids) // 4 for ids in merges.encode([w.encode() for w in words]))).tobytes()


class _Lengths(dict):
    """Both tiers as one dictionary: the broadcast table always, the worker's own finds until they take too much."""

    def __init__(self, table: tuple[str, bytes], limit: int = CACHE_BYTES):
        super().__init__()
        self.table, self.limit = table, limit
        self.restart()

    def restart(self) -> None:
        """Forget the second tier."""
        self.clear()
        self.bytes = 0
        if self.table[0]:
            self.update(zip(self.table[0].split("\0"), array("I", self.table[1])))

    def fill(self, merges: Merges, pieces: set[str]) -> None:
        if self.bytes > self.limit:
            self.restart()
        missing = list(pieces.difference(self))
        self.bytes += PIECE_BYTES * len(missing) + 4 * sum(map(len, missing))
        self.update(zip(missing, (len(ids) // 4 for ids in merges.encode([p.encode() for p in missing]))))


@lru_cache(maxsize=2)
def _lengths(data: bytes, pattern: str, table: tuple[str, bytes]) -> _Lengths:
    return _Lengths(table)


def counted(docs: DataFrame, vocabulary_path: str, limit: int = 512, pattern: str = BYTE_LEVEL, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs`` (doc_id, text).

    n_tokens is what the vocabulary's own library gives by default, without added begin, end or special tokens;
    over_limit says whether it is above ``limit``. Defined cases: a null or empty text has 0 bytes and 0 tokens;
    texts of any length are counted whole; bytes that are not UTF-8 are read and counted as replacement characters;
    repeated rows are counted alike; an empty table gives an empty result; other columns are not read.
    """
    data = Path(vocabulary_path).read_bytes()
    specials = special_strings(data)
    words, _ = frequent_pretokens(docs, specials, pattern, sample_rows)
    context = docs.sparkSession.sparkContext
    shipped, table = context.broadcast(data), context.broadcast(lengths_table(words, vocabulary(merges_of_json, data)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, pieces = vocabulary(merges_of_json, shipped.value), pieces_of(specials, pattern)
        lengths = _lengths(shipped.value, pattern, table.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts: list[int] = []
            for start, end in in_portions(texts):
                found = [pieces(text) for text in texts[start:end]]
                lengths.fill(merges, set().union(*(p for _, p in found)))
                counts.extend(n + sum(map(lengths.__getitem__, p)) for n, p in found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    wanted = docs.select("doc_id", F.make_valid_utf8("text").alias("text")).select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    found = wanted.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
