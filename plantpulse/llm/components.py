"""Connected components of a graph given as edges, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.staging import discard, staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the least of the node and its neighbours."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: bigint, not null); a component is named by its least node.

    Loops and repeated edges do no harm. Each round is written to the shared folder. Minima are taken
    before shuffles and joins are left to adaptive splitting, so a node that is linked with a third of
    all others is no single task's load. No edges: no rows. Rounds grow with the logarithm of the longest
    path.
    """
    edges = staged(edges.where("a <> b").select("a", "b").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        last, edges = edges, staged(_small_star(_large_star(edges).distinct()).where("a <> b").distinct(), "edges")
        discard(last)
        after = _state(edges)
        if after == before:
            break
        before = after
    # no node is both: the stars are disjoint
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
