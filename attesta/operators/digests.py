"""A tree of digests over lines: the identity of a corpus of any size, and where two corpora differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of a leaf's name; a leaf holds the lines whose digests begin with it.
DEPTH = 2


def digest_tree(lines: DataFrame, line: Column, depth: int = DEPTH) -> DataFrame:
    """(level, node, digest, lines) of every node, from the root (level 0, name '') to leaves of `depth` hex digits.

    Equal lines fold to a count first. A leaf's digest is taken over its line digests in order, with counts, so
    it holds one entry for each distinct line; a node's over those of its children in order. Nothing
    depends on the order or the partitions of the input. `depth` should grow with the logarithm of the
    lines, so that leaves stay small: 16^depth of them share all distinct lines evenly.
    """
    folded = lines.select(F.sha2(F.coalesce(line, F.lit("")), 256).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.concat("h", F.lit(":"), F.col("n").cast("string"))))
    level = folded.groupBy(F.substring("h", 1, depth).alias("node")).agg(F.sha2(F.array_join(entries, "\n"), 256).alias("digest"), F.sum("n").alias("lines"))
    out = level.withColumn("level", F.lit(depth))
    for k in range(depth - 1, -1, -1):
        children = F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda c: F.concat(c["node"], F.lit(":"), c["digest"]))
        level = level.groupBy(F.substring("node", 1, k).alias("node")).agg(F.sha2(F.array_join(children, "\n"), 256).alias("digest"), F.sum("lines").alias("lines"))
        out = out.unionByName(level.withColumn("level", F.lit(k)))
    return out.select("level", "node", "digest", "lines")


def changed_leaves(before: DataFrame, now: DataFrame) -> DataFrame:
    """(node, lines_before, lines_now) of the leaves in which two trees of one depth differ; equal roots give none.

    Level by level only children of nodes that differ are compared, so what is equal is passed over whole.
    """
    depth = max((r[0] for t in (before, now) for r in t.agg(F.max("level")).collect() if r[0] is not None), default=None)
    columns = ["node", "digest", "lines"]

    def differing(k: int, parents: DataFrame | None) -> DataFrame:
        sides = []
        for tree, mark in ((before, "before"), (now, "now")):
            own = tree.filter(F.col("level") == k).select(*columns)
            if parents is not None:
                own = own.join(parents, F.substring("node", 1, k - 1) == F.col("parent"), "left_semi")
            sides.append(own.toDF("node", f"digest_{mark}", f"lines_{mark}"))
        return sides[0].join(sides[1], "node", "full").filter(~F.col("digest_before").eqNullSafe(F.col("digest_now")))

    if depth is None:
        return before.select("node", F.col("lines").alias("lines_before"), F.col("lines").alias("lines_now"))
    found = differing(0, None)
    for k in range(1, depth + 1):
        found = differing(k, found.select(F.col("node").alias("parent")))
    return found.select("node", F.coalesce("lines_before", F.lit(0)).alias("lines_before"), F.coalesce("lines_now", F.lit(0)).alias("lines_now"))
