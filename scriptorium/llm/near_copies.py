"""Near copies of a stated likeness: wide SimHash fingerprints, multi-index hashing, one document of each group.

Two texts are near copies when the Jaccard likeness of their word shingles is ``similarity`` or more. Of two texts with
likeness j the shingle vectors have a cosine of about 2j / (1 + j), and SimHash bits differ with the chance that the
angle between them has of pi: 0.15 at 0.8. With 64 bits that is 10 differing bits, give or take 3, too coarse a ruler, so
fingerprints here have 256 bits, and ``radius_of`` allows two deviations above the mean: 50 bits at 0.8.

Multi-index hashing over such a radius: sixteen segments of 32 bits each, eight of adjacent bits and eight of every
eighth bit. A whole ball of the needed radius would hold thousands of values, nearly all of them improbable: the bits
in which near copies differ are those whose votes were close. So a small ball is enumerated by certainty, the 16 values
that flip the fewest and least certain bits, and both sides of a pair look up and are looked up: they meet if a value
of one's ball is in the other's. Where fingerprints meet, complete distances are compared.

Scale. Each distinct fingerprint gives 256 rows of two longs, exchanged once; the fingerprints themselves join only
the rows that met another's. Chance meetings take 32 equal bits, and places with many fingerprints give a spanning
forest, in blocks, as in ``simhash_dedup``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.components import component_roots
from scriptorium.llm.lineage import written
from scriptorium.llm.native import columns_of, fresh, quoted
from scriptorium.llm.simhash_dedup import in_blocks, spanning_forest, word_shingles

BITS = 256
SEGMENT_BITS = 32
UNSURE_BITS = 8
BALL = 16
_CHUNK = 1 << 15
#: The bits of each segment.
_SEGMENTS = np.array([range(s * SEGMENT_BITS, (s + 1) * SEGMENT_BITS) for s in range(8)] + [range(s, BITS, 8) for s in range(8)])


def _flips() -> np.ndarray:
    """The ball: which of a segment's least certain bits, by rank, each of its values flips."""
    ways = [w for size in range(4) for w in combinations(range(UNSURE_BITS), size)]
    likely = sorted(ways, key=lambda w: (sum(rank + 3 for rank in w), len(w)))[:BALL]
    return np.array([[rank in w for rank in range(UNSURE_BITS)] for w in likely], dtype=np.int64)


_FLIPS = _flips()


def radius_of(similarity: float) -> int:
    """Differing bits of two texts of that likeness: the expected number and two deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(BITS * share + 2 * math.sqrt(BITS * share * (1 - share)))


def wide_fingerprint(shingles: list[bytes]) -> tuple[bytes, bytes]:
    """256 majority bits, and for each segment the places of its bits with the closest votes; zeros for no shingles."""
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(shingles), _CHUNK):
        part = shingles[at : at + _CHUNK]
        digests = b"".join(d for seed in (1, 2) for d in map(xxhash.xxh3_128_digest, part, repeat(seed)))
        bits = np.unpackbits(np.frombuffer(digests, dtype=np.uint8).reshape(2, -1, BITS // 16), axis=2)
        votes += bits.sum(axis=1, dtype=np.uint16).reshape(-1)
    margin = votes * 2 - len(shingles)
    unsure = np.argsort(np.abs(margin)[_SEGMENTS], axis=1, kind="stable")[:, :UNSURE_BITS]
    return np.packbits(margin > 0).tobytes(), unsure.astype(np.uint8).tobytes()


def _prints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [wide_fingerprint(word_shingles(t.as_py(), words)) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.binary()) for c in (zip(*found) if found else ((), ())))], names=["doc_id", "print", "fp", "unsure"])

    return run


def ball_keys(fps: np.ndarray, unsure: np.ndarray) -> np.ndarray:
    """The keys that fingerprints (rows of bytes) are met at: the segment's number above the 32 bits of its value."""
    bits = np.unpackbits(fps, axis=1)[:, _SEGMENTS].astype(np.int64)
    values = bits @ (1 << np.arange(SEGMENT_BITS, dtype=np.int64))
    masks = (1 << unsure.astype(np.int64)) @ _FLIPS.T
    return (values[:, :, None] ^ masks) | (np.arange(len(_SEGMENTS), dtype=np.int64) << SEGMENT_BITS)[None, :, None]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            nodes, fps, unsure = batch.slice(start, 2000).columns
            n = len(nodes)
            raw = np.frombuffer(b"".join(fps.to_pylist()), dtype=np.uint8).reshape(n, -1)
            places = np.frombuffer(b"".join(unsure.to_pylist()), dtype=np.uint8).reshape(n, len(_SEGMENTS), UNSURE_BITS)
            keys = ball_keys(raw, places).reshape(n, -1)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(nodes.to_numpy(), keys.shape[1]))], names=["key", "rep"])


def _forests(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: list[tuple[int, int]] = []
            for fps, reps in zip(batch.column(0), batch.column(1)):
                rows = np.frombuffer(b"".join(fps.as_py()), dtype=np.uint64).reshape(-1, BITS // 64)
                links.extend(spanning_forest(rows, reps.values.to_numpy(), radius))
            us, vs = zip(*links) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def near_links(nodes: DataFrame, radius: int, block_rows: int = 20_000) -> DataFrame:
    """Links (u, v) among ``nodes`` (node, fp, unsure) that met, within ``radius`` bits: a forest of each place."""
    met = nodes.select("node", "fp", "unsure").mapInArrow(_keys, "key long, rep long").repartition("key")
    sizes = met.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = met.join(sizes.hint("shuffle_hash"), "key").join(nodes.select(F.col("node").alias("rep"), "fp"), "rep")
    return in_blocks(shared, ["key"], block_rows).select("members.fp", "members.rep").mapInArrow(_forests(radius), "u long, v long")


def with_fewer_links(links: DataFrame) -> DataFrame:
    """Links (u, v) with the same components as ``links`` (parent u, child v): each child and its parents linked to the
    least of them. A family that meets at many places has many parents a child, and their links become few. A child has
    one parent in each place, or pair of blocks, at most, so its list is short whatever the family's size."""
    parents = links.groupBy("v").agg(F.collect_set("u").alias("parents"))
    least = parents.select(F.array_append("parents", F.col("v")).alias("all")).select("all", F.array_min("all").alias("least"))
    return least.select(F.explode("all").alias("u"), F.col("least").alias("v")).filter("u <> v").distinct()


def near_copy_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, block_rows: int = 20_000) -> DataFrame:
    """(group, fp, first) for each distinct fingerprint of ``docs`` (doc_id, text).

    group is a long shared by near copies; first is the least (nameless, doc_id, print) with that fingerprint, where
    nameless says that doc_id is null and print is a 64-bit hash of the text. The result reads two written tables.
    """
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"), F.col("text").cast("binary").alias("text"))
    prints = wanted.mapInArrow(_prints(words), "doc_id long, print long, fp binary, unsure binary")
    least = F.min(F.struct(F.isnull("doc_id").alias("nameless"), "doc_id", "print")).alias("first")
    distinct = prints.groupBy("fp").agg(F.min("unsure").alias("unsure"), least)
    # the numbers are given while the table is written, so they are fixed afterwards
    nodes = written(distinct.select(F.monotonically_increasing_id().alias("node"), "fp", "unsure", "first"))
    roots = component_roots(with_fewer_links(near_links(nodes, radius_of(similarity), block_rows))).withColumnRenamed("node", "of")
    return nodes.join(roots, nodes["node"] == roots["of"], "left").select(F.coalesce("root", "node").alias("group"), "fp", "first")


def keep_one_of_each_group(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` (with doc_id, text and any other columns) with one row of each group of near copies.

    The row of the smallest doc_id stays, rows without one coming last; of different texts with that doc_id in the
    group, the one with the smallest 64-bit hash; of rows equal in both, the first by their other columns that can be
    compared as strings. Different documents that share a doc_id but no group all stay. Texts without words are one
    group, null or empty. An empty table stays empty.
    """
    groups = near_copy_groups(docs, words, similarity)
    kept = groups.groupBy("group").agg(F.min("first").alias("first"))
    names = [fresh(docs, n) for n in ("near_id", "near_nameless", "near_print", "near_rank")]
    row_id = lambda id, nameless, print: [F.coalesce(id, F.lit(0)).alias(names[0]), nameless.alias(names[1]), print.alias(names[2])]
    own = row_id(F.col("doc_id").cast("long"), F.isnull("doc_id"), F.xxhash64("text"))
    chosen = docs.select(*columns_of(docs), *own).join(kept.select(*row_id(F.col("first.doc_id"), F.col("first.nameless"), F.col("first.print"))), names[:3], "left_semi")
    rest = [F.col(quoted(f.name)).cast("string") for f in docs.schema if f.dataType.typeName() not in ("struct", "array", "map", "variant") and f.name.lower() not in ("doc_id", "text")]
    once = Window.partitionBy(*names[:3]).orderBy(*rest, F.lit(1))
    return chosen.withColumn(names[3], F.row_number().over(once)).filter(F.col(names[3]) == 1).select(*columns_of(docs))
