"""Connected components by alternating large-star and small-star rounds.

Each round regroups the edges around the smallest neighbour, so trees flatten in a logarithmic number of rounds and
no node's neighbourhood is ever collected: both stars are one partial aggregate (the smallest neighbour) and one
join whose large partitions the adaptive planner may split. A round is a written table; the one before it is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.lineage import discard_since, mark, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # every edge has u > v here, as both stars point from the larger node to the smaller
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def component_roots(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with an edge in ``edges`` (columns u, v of an orderable type).

    root is the smallest node reachable; the smallest node itself has no row. Self-loops, repeated and reversed edges
    and null ends are allowed and change nothing. An empty input gives an empty result. The result reads one table in
    the shared folder.
    """
    place = mark()
    clean = edges.filter("u is not null and v is not null and u <> v")
    current = written(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _signature(current)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        current = written(_small_star(_large_star(current)))
        discard_since(edges.sparkSession, place, keep=1)
        after = _signature(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
