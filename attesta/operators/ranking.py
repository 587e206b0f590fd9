"""Ranking operators that hold when one group is a large share of the table."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.session import materialise


def top_k(df: DataFrame, k: int, keys: list[str], order: list[Column], rank_name: str = "rank") -> DataFrame:
    """First k rows per group, with their rank. `order` must be total.

    The filter directly on row_number lets Spark cut every group to k rows in each map task
    before the shuffle (WindowGroupLimit), so a hot group never travels whole.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_name, F.row_number().over(window)).filter(F.col(rank_name) <= k)


def latest_by(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last row per key by a total order, as an aggregate: it combines before the shuffle."""
    ordering = F.struct(*order)
    packed = F.struct(*[F.col(c) for c in values])
    return (
        df.groupBy(*keys)
        .agg(F.max_by(packed, ordering).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in values])
    )


def earliest_by(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The first row per key by a total order, as an aggregate."""
    ordering = F.struct(*order)
    packed = F.struct(*[F.col(c) for c in values])
    return (
        df.groupBy(*keys)
        .agg(F.min_by(packed, ordering).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in values])
    )


def row_numbers(
    df: DataFrame, keys: list[str], position: str, name: str = "row_number", ties: tuple[str, ...] = (), distinct: bool = False
) -> DataFrame:
    """row_number over (keys, position, ties) without putting a hot group into one task.

    (keys, position, ties) is a total order; `position` may be a struct. The table is cut once into
    ranges of that order, as many as its size asks for, and written: a group of any size spreads
    over as many ranges as it fills. A range is numbered on its own. Only the group that a range begins with
    can have rows in ranges before it, so there are no more shifts than ranges, and they come by broadcast.
    With no keys this is a global numbering. With `distinct` equal rows, which are in one range, count once.
    """
    cut = df.repartitionByRange(*keys, position, *ties)
    ranged = materialise((cut.distinct() if distinct else cut).withColumn("_slice", F.spark_partition_id()), "ranges")

    def held(other: DataFrame) -> Column:
        return reduce(and_, (ranged[k].eqNullSafe(other[f"_{k}"]) for k in keys), F.lit(True))

    split = ranged
    if keys:
        begins = ranged.groupBy("_slice").agg(F.min(F.struct(*keys)).alias("b")).select("b.*").distinct()
        begins = begins.withColumnsRenamed({k: f"_{k}" for k in keys})
        split = ranged.join(F.broadcast(begins), held(begins), "left_semi")
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    shifts = split.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_rows")).withColumn("_offset", F.sum("_rows").over(before)).filter("_offset > 0")
    shifts = shifts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_slice").alias("_at"), "_offset")
    local = W.partitionBy("_slice", *keys).orderBy(position, *ties)
    return (
        ranged.join(F.broadcast(shifts), (ranged["_slice"] == shifts["_at"]) & held(shifts), "left")
        .withColumn(name, F.row_number().over(local) + F.coalesce("_offset", F.lit(0)))
        .drop("_slice", "_at", "_offset", *[f"_{k}" for k in keys])
    )


def round_robin(
    df: DataFrame, cap: int, group: str, order: list[Column], rank_name: str = "turn"
) -> DataFrame:
    """Take items in turns across groups until `cap` are taken.

    The n-th item of every group precedes the (n+1)-th of any, so this is a limit over
    (turn, group). No group can give more than `cap`, which bounds what is sorted globally.
    """
    turns = top_k(df, cap, [group], order, rank_name)
    return turns.orderBy(rank_name, group).limit(cap)


def interleave(left: DataFrame, right: DataFrame, position: str) -> DataFrame:
    """Alternate two numbered lists, left first; the tail of the longer one follows."""
    both = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)))
    return both.orderBy(position, "_side").drop("_side")
