"""Document fingerprints: SimHash of weighted terms, and search for all fingerprints within a Hamming radius.

Terms are a text's distinct lower-cased words. A term's weight grows with its length, as short words are common to all
texts, and slowly with its count. Every term's 128 hash bits vote with its weight for or against each bit of the
fingerprint.

Search. A fingerprint is cut into radius + 1 blocks; two fingerprints within the radius agree in at least one block
entirely, so a table of the fingerprints permuted to start with that block holds both at one key. The fingerprints
that agree with a searched one meet it at (block number, block value) and complete distances are compared there;
a place with many is dealt to parts by a salt. Distinct fingerprints are searched, so copies meet once, and a place
answers with one row for each searched fingerprint, never with pairs.

The edited text of a document ends with the beginning of the next one, so neighbours in id order must meet. Ids are
cut into ranges at quantiles; every row is dealt to its range's task, and the first row of each range also, as a
look-ahead, to the range before. A task then reads its rows in order and holds two texts at a time. Texts move once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.lineage import written

BITS = 128
#: Documents dealt to a task, and the most tasks they are dealt to.
ROWS_A_TASK = 4_000
MOST_TASKS = 1 << 16
#: Starts of ranges are searched in two steps, of so many each.
_STEP = 256
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CHUNK = 1 << 15
_LONGEST = 12
_FIRST = -(1 << 63)


def fingerprint(text: str) -> bytes:
    """128 bits; all zero for a text without words. Equal texts have equal fingerprints."""
    counts = Counter(text.encode().translate(_LOWER).split())
    if not counts:
        return bytes(BITS // 8)
    terms = list(counts)
    times = np.fromiter(counts.values(), dtype=np.int64, count=len(terms))
    lengths = np.minimum(np.fromiter(map(len, terms), dtype=np.int64, count=len(terms)), _LONGEST)
    weights = lengths * (1 + (times > 1) + (times > 3) + (times > 7))
    votes = np.zeros(BITS, dtype=np.float64)
    for at in range(0, len(terms), _CHUNK):
        hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, terms[at : at + _CHUNK])), dtype=np.uint8)
        bits = np.unpackbits(hashes.reshape(-1, BITS // 8), axis=1)
        votes += weights[at : at + _CHUNK].astype(np.float32) @ bits.astype(np.float32)  # exact: sums below 2**24
    return np.packbits(votes * 2 > weights.sum()).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The share of equal bits."""
    return 1 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / (8 * len(a))


def edited(text: str, following: str) -> str:
    """The text with its last half, rounded down, replaced by as many first characters of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) for every row of ``docs`` (doc_id, text); fingerprint is binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.make_valid_utf8("text").alias("text")).mapInArrow(run, "doc_id long, fingerprint binary")


def _range_of(key: Column, starts: list[int]) -> Column:
    """The number of the last start that is not above the key; keys below all starts are in the first range."""
    every = F.lit(starts)
    block = F.greatest(F.size(F.filter(F.lit(starts[::_STEP]), lambda s: s <= key)) - 1, F.lit(0))
    inside = F.size(F.filter(F.slice(every, block * _STEP + 1, F.lit(_STEP)), lambda s: s <= key))
    return F.greatest(block * _STEP + inside - 1, F.lit(0))


def in_id_order(docs: DataFrame, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """(range, ahead, key, doc_id, text): rows dealt to ranges of doc_id and sorted in them, each followed by the first
    rows of the next range (of the first range after the last), which are marked ``ahead``."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST))
    keyed = docs.select("doc_id", F.coalesce(F.make_valid_utf8("text"), F.lit("")).alias("text"), key.alias("key"))
    rows = docs.count()
    tasks = max(1, min(MOST_TASKS, -(-rows // rows_a_task)))
    shares = [i / tasks for i in range(1, tasks)]
    quantiles = F.percentile_approx("key", shares, max(10_000, 4 * tasks)) if shares else F.array().cast("array<bigint>")
    at = docs.select(key.alias("key")).agg(F.min("key").alias("least"), quantiles.alias("cuts")).first()
    starts = sorted({at["least"], *(at["cuts"] or [])} - {None}) or [_FIRST]
    ranged = keyed.withColumn("range", _range_of(F.col("key"), starts))
    here = F.struct(F.col("range").alias("range"), F.lit(False).alias("ahead"))
    before = F.struct(F.pmod(F.col("range") - 1, F.lit(len(starts))).cast("int").alias("range"), F.lit(True).alias("ahead"))
    places = F.when(F.get(F.lit(starts), F.col("range")) == F.col("key"), F.array(here, before)).otherwise(F.array(here))
    dealt = ranged.withColumn("place", F.explode(places)).select("place.range", "place.ahead", "key", "doc_id", "text")
    return dealt.repartitionById(len(starts), F.col("range")).sortWithinPartitions("range", "ahead", "key", "text")


def compared_with_next(docs: DataFrame, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """(doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The next document is the next row by (doc_id, text), the first row's after the last. Defined cases: a null text
    counts as empty; null ids come first; of rows that share an id, ordered by text, each is compared with its own
    next row; a single row is followed by itself; an empty table gives an empty result; other columns are not read; a
    text of any length is read whole, two at a time; bytes that are not UTF-8 are read as replacement characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its next one
        for batch in batches:
            out: list[tuple] = []
            chars = 0
            for number, ahead, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if held is None and ahead:
                    continue
                own = fingerprint(text)
                if held is not None:
                    if held[0] != number:
                        raise RuntimeError("a range of ids has no look-ahead row")
                    _, before_id, before, before_print = held
                    changed = edited(before, text)
                    changed_print = fingerprint(changed)
                    out.append((before_id, len(before), changed, before_print, changed_print, likeness(before_print, changed_print), likeness(before_print, own)))
                    chars += len(changed)
                held = None if ahead else (number, doc_id, text, own)
                if chars > 1 << 22:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)
                    out, chars = [], 0
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_text", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    rows = in_id_order(docs, rows_a_task).select("range", "ahead", F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_text string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double")


def _block(fp: Column, number: int, blocks: int) -> Column:
    """Block ``number`` of a binary fingerprint; the first blocks are a byte longer where bytes don't divide evenly."""
    size, longer = divmod(BITS // 8, blocks)
    start = number * size + min(number, longer)
    return F.substring(fp, start + 1, size + (number < longer))


def _near(radius: int):
    """For each searched fingerprint of a place: how many documents of the place are within the radius, and the least id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[bytes, int, int | None]] = []
            for block, blocks, searched, others in zip(*(c.to_pylist() for c in batch.columns)):
                words = lambda prints: np.frombuffer(b"".join(prints), dtype=np.uint8).reshape(-1, BITS // 8)
                fps, rows = words(o["fp"] for o in others), np.array([o["rows"] for o in others])
                ids = [o["least"] for o in others]
                size, longer = divmod(BITS // 8, blocks)
                ends = [(i + 1) * size + min(i + 1, longer) for i in range(block)]
                for fp in searched:
                    differing = np.bitwise_count(fps ^ words([fp]))
                    near = differing.sum(axis=1, dtype=np.int64) <= radius
                    start = 0
                    for end in ends:  # those that agree in an earlier block were met there
                        near &= differing[:, start:end].any(axis=1)
                        start = end
                    if near.any():
                        found = [ids[i] for i in np.nonzero(near)[0] if ids[i] is not None]
                        out.append((fp, int(rows[near].sum()), min(found, default=None)))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64()))], names=["fp", "n_near", "least_near"])

    return run


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = 3, part_rows: int = 20_000) -> DataFrame:
    """(fp, n_near, least_near): for each distinct fingerprint of ``queries`` the number of rows of ``prints`` within
    ``radius`` bits and the smallest of their doc_ids.

    Both have doc_id and fingerprint (binary). Fingerprints with nothing within the radius have no row. Null ids count
    but are never the smallest; a null fingerprint is not searched and not found. At a place above ``part_rows`` the
    others are dealt to parts by a hash and the searched ones go to every part, themselves in portions.
    """
    blocks = radius + 1
    if not 0 <= radius < BITS // 8:
        raise ValueError("radius + 1 blocks of whole bytes are needed")
    tables = F.explode(F.array(*(F.struct(F.lit(i).alias("block"), _block(F.col("fp"), i, blocks).alias("value")) for i in range(blocks)))).alias("t")
    found = prints.filter("fingerprint is not null").groupBy(F.col("fingerprint").alias("fp")).agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("least"))
    searched = queries.select(F.col("fingerprint").alias("fp")).filter("fp is not null").distinct().select("fp", tables).select("fp", "t.block", "t.value")
    others = found.select("fp", "rows", "least", tables).select("fp", "rows", "least", "t.block", "t.value")
    places = searched.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n_searched"))
    met = others.join(places, ["block", "value"])
    sizes = met.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n_others"), F.first("n_searched").alias("n_searched"))
    parts, portions = F.ceil(F.col("n_others") / part_rows).cast("int"), F.ceil(F.col("n_searched") / part_rows).cast("int")
    salt = lambda n: F.pmod(F.xxhash64("fp", F.lit(1)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    table_side = met.drop("n_searched").join(sizes, ["block", "value"]).select("block", "value", salt(parts).alias("part"), every(portions).alias("portion"), F.struct("fp", "rows", "least").alias("other"), F.lit(None).cast("binary").alias("wanted"))
    query_side = searched.join(sizes, ["block", "value"]).select("block", "value", every(parts).alias("part"), salt(portions).alias("portion"), F.lit(None).cast(table_side.schema["other"].dataType).alias("other"), F.col("fp").alias("wanted"))
    gathered = table_side.unionByName(query_side).groupBy("block", "value", "part", "portion").agg(F.collect_list("wanted").alias("searched"), F.collect_list("other").alias("others"))
    near = gathered.filter(F.size("searched") > 0).select("block", F.lit(blocks).alias("blocks"), "searched", "others").mapInArrow(_near(radius), "fp binary, n_near long, least_near long")
    return near.groupBy("fp").agg(F.sum("n_near").alias("n_near"), F.min("least_near").alias("least_near"))


def digests_with_neighbours(docs: DataFrame, radius: int = 3, every: int = 20) -> DataFrame:
    """compared_with_next's rows with the edited text as its SHA-256, and the search over all fingerprints.

    n_near and least_near are within_radius's answer for the rows whose doc_id is divisible by ``every``, themselves
    included; null for the others. The compared rows, without texts, are one written table, which the result reads.
    """
    compared = compared_with_next(docs)
    digest = F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256")
    rows = written(compared.select("doc_id", "n_chars", digest, "fingerprint", "edited_fingerprint", "near_edited", "near_next"))
    asked = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    near = within_radius(rows.filter(asked), rows, radius)
    answered = rows.filter(asked).join(near.withColumnRenamed("fp", "near_fp"), F.col("fingerprint") == F.col("near_fp"), "left").drop("near_fp")
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in near.schema if f.name != "fp"}
    return answered.unionByName(rows.filter(~asked).withColumns(nothing))
