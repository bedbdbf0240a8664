"""Mixing sources to target weights by Poisson replication, in native expressions.

Each source has a mean repetition rate: target weight / share of the corpus * size of the mix. A document's number of
copies is drawn by inverting the Poisson distribution with its source's mean at a uniform number hashed from the
document's id and the seed, so a run can be repeated and lost tasks recompute the same draw. The document is exploded
by its count and the copies are dealt to partitions, and ordered inside them, by hashes of (id, copy): a global
shuffle that moves each copy once and, as the hash knows nothing of the source, spreads a hot source evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.lineage import written
from scriptorium.llm.native import columns_of, fresh

#: Up to so many bytes the sources' distributions are broadcast; above, they are joined by a shuffle salted for the hot
#: ones. Both ways give the same rows.
BROADCAST_BYTES = 32 << 20
_SOURCE_BYTES = 256  # of a source besides its distribution
_SALTS = 32
#: Up to this mean exp(-mean) is well inside the doubles; above it the distribution is summed around its mean.
DIRECT_RATE = 400


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) from 52 bits of the md5 of the keys and the seed; the same in any engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, size: float = 1.0) -> DataFrame:
    """(source, n_docs, rate) for each source, counted over all documents.

    weights: target weight by source, normalised to sum 1 over those present; sources not named get none. Without it
    a source's target weight is its document count to the power ``temperature``. size: documents in the mix over
    documents in the corpus. A null source is a source of its own. An empty table gives no rows. The documents are
    counted once, into a written table of one row a source.
    """
    counts = written(docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs")))
    if weights is None:
        wanted = F.pow(F.col("n_docs").cast("double"), F.lit(float(temperature)))
    else:
        wanted = F.lit(0.0)
        for name, weight in sorted(weights.items()):
            if weight < 0:
                raise ValueError(f"negative weight for {name}")
            wanted = F.when(F.col("source") == name, F.lit(float(weight))).otherwise(wanted)
    aimed = counts.withColumn("aim", wanted)
    total = aimed.agg(F.sum("aim").alias("aims"), F.sum("n_docs").alias("docs")).first()
    scale = float(size) * (total["docs"] or 0) / total["aims"] if total["aims"] else 0.0
    return aimed.select("source", "n_docs", (F.col("aim") * F.lit(scale) / F.col("n_docs")).alias("rate"))


def first_step(rate: Column) -> Column:
    """The smallest number that a draw of 52 bits can reach: zero, or twelve deviations below a large mean."""
    low = F.floor(rate - F.lit(12.0) * F.sqrt(rate) - F.lit(24.0))
    return F.when(rate > DIRECT_RATE, low).otherwise(F.lit(0)).cast("int")


def last_step(rate: Column) -> Column:
    """A number beyond any that a draw of 52 bits can reach."""
    return F.ceil(rate + F.lit(12.0) * F.sqrt(rate) + F.lit(24.0)).cast("int")


def poisson_steps(rate: Column) -> Column:
    """The distribution function of Poisson(rate) at first_step, and on until far beyond any drawn number.

    The terms follow p(k) = p(k-1) * rate / k. Up to DIRECT_RATE they start from p(0) = exp(-rate). Above, where that
    leaves the doubles' range, they start from one at first_step and are divided by their sum: what lies below or
    beyond weighs less than exp(-70), far under the 2 ** -53 of the smallest draw.
    """
    first = first_step(rate)
    p0 = F.when(rate > DIRECT_RATE, F.lit(1.0)).otherwise(F.exp(-rate))
    start = F.struct(p0.alias("p"), p0.alias("sum"), F.array(p0).alias("steps"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"), F.concat(acc["steps"], F.array(acc["sum"] + p)).alias("steps"))

    def finish(acc: Column) -> Column:
        scaled = F.transform(acc["steps"], lambda x: x / acc["sum"])
        return F.when(rate > DIRECT_RATE, scaled).otherwise(acc["steps"])

    return F.aggregate(F.sequence(first + 1, last_step(rate)), start, step, finish)


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, size: float = 1.0, seed: int = 1, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` (with doc_id, source) replicated to the target mix and shuffled globally, plus a column ``copy_no``.

    Defined cases: repeated rows are drawn alike, each by itself; null ids share one draw; a document drawn zero times
    leaves the mix; a source of weight zero leaves it altogether; a column named copy_no, in any case, is replaced, the
    others are carried along whatever their names and texts; a source may be repeated any number of times a document;
    an empty table gives an empty mix. The result reads one written table, of a row a source.
    """
    source, first, steps, salt, deal, copies, place = (fresh(docs, f"mix_{n}") for n in ("source", "first", "steps", "salt", "deal", "copies", "place"))
    rates = source_rates(docs, weights, temperature, size)
    tables = rates.select(F.col("source").alias(source), first_step(F.col("rate")).alias(first), poisson_steps(F.col("rate")).alias(steps))
    same = F.col("source").eqNullSafe(F.col(source))
    kept = columns_of(docs, without=["copy_no"])
    needed = rates.agg(F.sum((last_step(F.col("rate")) - first_step(F.col("rate")) + 1).cast("double") * 8 + _SOURCE_BYTES).alias("bytes")).first()["bytes"] or 0
    if needed <= broadcast_bytes:
        joined = docs.select(*kept).join(F.broadcast(tables), same)
    else:
        salted = tables.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        dealt = docs.select(*kept, F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)).cast("int").alias(deal))
        joined = dealt.join(salted, same & (F.col(deal) == F.col(salt)))
    drawn = F.col(first) + F.size(F.filter(steps, lambda step: step < uniform(seed, F.col("doc_id"))))
    counted = joined.select(*kept, drawn.alias(copies)).filter(F.col(copies) > 0)
    exploded = counted.select(*kept, F.explode(F.sequence(F.lit(1), F.col(copies))).alias("copy_no"))
    spot = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("copy_no"))
    shuffled = exploded.withColumn(place, spot).repartition(place).sortWithinPartitions(place)
    return shuffled.select(*kept, "copy_no")
