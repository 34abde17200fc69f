"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.session import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour or itself."""
    both = edges.select(F.col("big").alias("u"), F.col("small").alias("v")).unionAll(
        edges.select(F.col("small").alias("u"), F.col("big").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("big"), F.col("m").alias("small"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    least = edges.groupBy("big").agg(F.min("small").alias("m"))
    tied = edges.join(least, "big").where("small > m").select(F.col("small").alias("big"), F.col("m").alias("small"))
    return tied.unionAll(least.select("big", F.col("m").alias("small"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    """Count and content hash of a set of edges; two numbers reach the driver."""
    mark = F.xxhash64("big", "small")
    row = edges.agg(F.count("*"), F.bit_xor(mark), F.sum(mark.cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for each node that has an edge.

    ``edges`` has bigint columns src and dst; loops and repeated edges do no harm, and nodes
    without an edge to another node are not returned. The number of rounds grows with the
    logarithm of the number of nodes, not with the longest path. A hub's edges meet one row
    of minima in each join, so adaptive execution may split them. Each round is a table in
    the shared folder and replaces the one before.
    """
    current = written(
        edges.where("src <> dst")
        .select(F.greatest("src", "dst").alias("big"), F.least("src", "dst").alias("small"))
        .distinct(),
        "edges",
    )
    before = _digest(current)
    while before[0]:
        following = written(_small_star(_large_star(current)), "edges")
        after = _digest(following)
        discard(current)
        current = following
        if after == before:
            break
        before = after
    return current.select(F.col("big").alias("node"), F.col("small").alias("component")).unionAll(
        current.select(F.col("small").alias("node"), F.col("small").alias("component")).distinct()
    )
