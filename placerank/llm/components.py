"""Connected components of an edge table by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, unsent


def _fingerprint(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.bit_xor(h.bitwiseAND(F.col("a")))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge that joins two different nodes; root is the component's smallest node.

    `edges` has columns a and b of one type; nulls are left out, direction, repeats and loops do not matter, no
    edges give no rows. Each step only takes minima by node and joins them back, so a node with many neighbours is
    an aggregation and a join that Spark may split. Edges are stored after each round in the shared folder; the number
    of rounds grows with the logarithm of a component's size."""
    a, b = F.col("a"), F.col("b")
    edges = stored(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _fingerprint(edges)
    while before[0]:
        # Large star: the greater neighbours of each node are tied to its smallest neighbour, or to itself.
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(unsent(least), "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        # Small star: the smaller neighbours of each node, and the node, are tied to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(unsent(low), "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        edges = stored(tied.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    star = edges.select(a.alias("node"), b.alias("root"))
    return star.unionByName(edges.select(b.alias("node"), b.alias("root")).distinct())
