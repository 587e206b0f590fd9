"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.session import materialise


def _star(edges: DataFrame, node: str, other: str) -> DataFrame:
    """Each edge with the smallest node among its node and that node's neighbours.

    The minimum is aggregated first (it combines in the map tasks) and joined back, so a node of any
    degree is never gathered; the join's large side may be split.
    """
    least = edges.groupBy(node).agg(F.least(F.col(node), F.min(other)).alias("root"))
    return edges.join(least, node)


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    out = _star(both, "a", "b").filter("b > a").select(F.col("root").alias("a"), "b")
    return out.filter("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Edges are (a < b): every smaller neighbour of b, and b itself, goes to the smallest of them."""
    starred = _star(edges, "b", "a")
    pairs = starred.select(F.explode(F.array(
        F.struct(F.col("root").alias("a"), F.col("b").alias("b")),
        F.struct(F.col("root").alias("a"), F.col("a").alias("b")),
    )).alias("e")).select("e.a", "e.b")
    return pairs.filter("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a, 1))")).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node it is linked to.

    Edges may repeat, run either way or be loops; edges with a null end are no links. Rounds grow with
    the logarithm of the number of nodes. Each round is a written table, so a lost executor costs its
    own tasks only. Nodes without edges are not in the result.
    """
    current = materialise(
        edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    before = _mark(current)
    while before[0]:
        current = materialise(_small(_large(current)), "edges")
        after = _mark(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return roots.unionByName(current.select(F.col("b").alias("node"), F.col("a").alias("root")))
