"""SimHash near-duplicate classes by multi-index hashing.

A document's fingerprint has 64 bits, each the majority vote of its word shingles' hashes. Two documents are linked
when their fingerprints differ in at most ``radius`` bits; a class is a connected component of links.

Finding the links. The fingerprint is cut into two 32-bit segments. If two fingerprints differ in at most three bits,
then in at least one segment they differ in at most one bit (pigeonhole). So each distinct fingerprint looks up, in
the table of each segment's values, the Hamming ball of radius one around its own value. Of two values at distance one
it is enough that the one with the zero bit looks up the other, so only zero bits are flipped: 17 lookups a segment on
average. Fingerprints that meet at a table value are compared over all 64 bits.

Scale. Copies collapse to one distinct fingerprint by a partial aggregate before anything else. 32-bit segments keep
chance meetings rare up to billions of fingerprints. Where distinct fingerprints meet at one value no pairs are
emitted: the meeting place's fingerprints are searched breadth first and only a spanning forest of the true links
leaves it, which has the same components. A meeting place above ``block_rows`` (a family of near copies) is split once
more, by balls around the 16-bit halves of the other segment, of which one differs in at most one bit; what is still
above it is cut into blocks, and every pair of blocks is searched by itself, so no task holds more than two blocks.

The contract of the registered query fixes three words and three bits. A likeness of 0.8 lies far beyond three bits;
for that see ``near_copies``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.components import component_roots
from scriptorium.llm.lineage import written
from scriptorium.llm.native import quoted

SEED = 42
SEGMENT_BITS = 32
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CHUNK = 1 << 16


def word_shingles(text: str | bytes | None, words: int) -> list[bytes]:
    """All shingles of ``words`` lower-cased (A-Z) words, repeats included; the whole sequence if it is shorter."""
    raw = text if isinstance(text, bytes) else (text or "").encode()
    tokens = raw.translate(_LOWER).split()
    if len(tokens) <= words:
        return [b" ".join(tokens)] if tokens else []
    return list(map(b" ".join, zip(*(tokens[i:] for i in range(words)))))


def simhash64(shingles: list[bytes]) -> int:
    """The 64-bit majority fingerprint of the shingles, unsigned; zero for none."""
    if not shingles:
        return 0
    votes = np.zeros(64, dtype=np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=len(shingles))
    for at in range(0, len(hashes), _CHUNK):
        octets = hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp) for every row of ``docs``; fp is the fingerprint as a signed long.

    A null or wordless text has fingerprint zero. Other columns are not read. Texts are taken as bytes, so invalid
    UTF-8 is hashed as it stands; votes are summed in portions, so a text of any length takes bounded memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((simhash64(word_shingles(t.as_py(), words)) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    wanted = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("binary").alias("text"))
    return wanted.mapInArrow(run, "doc_id long, fp long")


def spanning_forest(fps: np.ndarray, names: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among the fingerprints (rows of 64-bit words) of one meeting place.

    Found breadth first from the smallest name on, so that the many places where the same family meets give much the
    same links, to its smallest names.
    """
    order = np.argsort(names)
    fps, names = fps[order], names[order]
    left = np.arange(len(fps))
    while len(left) > 1:
        queue, left = deque([left[0]]), left[1:]
        while queue and len(left):
            node = queue.popleft()
            near = np.bitwise_count(fps[left] ^ fps[node]).sum(axis=1, dtype=np.int64) <= radius
            hits, left = left[near], left[~near]
            for hit in hits.tolist():
                yield int(names[node]), int(names[hit])
            queue.extend(hits.tolist())


def _forests(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us: list[int] = []
            vs: list[int] = []
            for fps, reps in zip(batch.column(0), batch.column(1)):
                a, b = fps.values, reps.values
                if len(a) == 2:
                    x, y = a[0].as_py(), a[1].as_py()
                    pairs = [(b[0].as_py(), b[1].as_py())] if ((x ^ y) & 0xFFFFFFFFFFFFFFFF).bit_count() <= radius else []
                else:
                    pairs = spanning_forest(a.to_numpy(zero_copy_only=False).view(np.uint64)[:, None], b.to_numpy(zero_copy_only=False), radius)
                for u, v in pairs:
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _segment(number: int):
    return f"(shiftrightunsigned(fp, {number * SEGMENT_BITS}) & 4294967295L)"


def _upward_ball(value: str, bits: int) -> str:
    """SQL for the value and all values that differ from it by one bit which is zero in it."""
    return f"concat(array({value}), transform(filter(sequence(0, {bits - 1}), b -> shiftright({value}, b) & 1L = 0), b -> {value} | shiftleft(1L, b)))"


def in_blocks(places: DataFrame, keys: list[str], block_rows: int) -> DataFrame:
    """One row for each pair of blocks of each meeting place: the keys and ``members``, a list of (fp, rep).

    ``places`` has the keys, fp, rep and n, the rows of the place. Up to block_rows a place is one block.
    """
    blocks = F.ceil(F.col("n") / F.lit(block_rows)).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int")
    pairs = F.expr("transform(sequence(0, blocks - 1), other -> struct(least(own, other) as i, greatest(own, other) as j))")
    dealt = places.withColumn("blocks", blocks).withColumn("own", own).select(*keys, "fp", "rep", F.explode(pairs).alias("pair"))
    return dealt.groupBy(*keys, "pair").agg(F.collect_list(F.struct("fp", "rep")).alias("members")).filter(F.size("members") > 1)


def hamming_links(distinct: DataFrame, radius: int = 3, block_rows: int = 20_000) -> DataFrame:
    """Links (u, v) with the same components as all pairs of ``distinct`` (fp, rep) within ``radius`` bits.

    fp must be distinct; rep is any long that names it. radius is at most 3, so that one segment is within one bit.
    """
    if not 0 <= radius <= 3:
        raise ValueError("two segments with balls of radius one find at most three differing bits")
    values = distinct.select("fp", "rep", F.expr(f"inline(array({', '.join(f'named_struct("seg", {s}, "value", {_segment(s)})' for s in (0, 1))}))"))
    flips = _upward_ball("value", SEGMENT_BITS) if radius > 1 else "array(value)"
    probes = values.select("fp", "rep", "seg", F.expr(f"explode({flips})").alias("key"))
    table = values.select("seg", F.col("value").alias("key")).distinct()
    met = probes.join(table, ["seg", "key"], "left_semi")
    sizes = met.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    placed = met.join(sizes, ["seg", "key"])
    whole = in_blocks(placed.filter(F.col("n") <= block_rows), ["seg", "key"], block_rows)
    # crowded places: once more by balls around the halves of the other segment
    other = f"(case when seg = 0 then {_segment(1)} else {_segment(0)} end)"
    halves = ", ".join(f"transform({_upward_ball(f'(shiftright(other, {16 * h}) & 65535L)', 16)}, x -> x + {h << 16}L)" for h in (0, 1))
    crowded = placed.filter(F.col("n") > block_rows).withColumn("other", F.expr(other)).select("seg", "key", "fp", "rep", F.expr(f"explode(concat({halves}))").alias("half"))
    counts = crowded.groupBy("seg", "key", "half").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    split = in_blocks(crowded.join(counts, ["seg", "key", "half"]), ["seg", "key", "half"], block_rows)
    groups = whole.select("members").unionByName(split.select("members"))
    return groups.select("members.fp", "members.rep").mapInArrow(_forests(radius), "u long, v long")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``; component_id is the smallest doc_id reachable by links.

    Defined cases: null, empty and wordless texts have fingerprint zero and are linked to each other like any other;
    repeated rows each have a row; a null doc_id has its class's component_id, or null where no member has an id; an
    empty table gives an empty result; columns beyond the two named are ignored, whatever their names; texts of any
    length and invalid UTF-8 are hashed as they stand. The result reads two tables in the shared folder.
    """
    prints = written(fingerprints(docs, id_col, text_col, words))
    # links name fingerprints, which are never null; ids come in afterwards, as some fingerprints have none
    named = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = component_roots(hamming_links(named.select("fp", F.col("fp").alias("rep")), radius))
    rooted = named.join(roots, named["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = roots.select(F.col("root").alias("fp")).distinct()
    least = rooted.join(linked, rooted["root"] == linked["fp"], "left_semi").groupBy("root").agg(F.min("least").alias("of_class"))
    classes = rooted.join(least, "root", "left").select("fp", F.coalesce("of_class", "least").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp):
    """A long as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
