"""Joins that hold when a few keys carry much of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than one row in so many of all comes by broadcast. There are fewer of them than this number.
SHARE = 10_000
#: Rows of a key that one task may have to meet from either side.
BLOCK = 1_000
#: Rows up to which a table goes whole to all executors.
FEW = 1_000_000


def attach(rows: DataFrame, keys: list[str], stats: DataFrame, count: str, share: int = SHARE) -> DataFrame:
    """Rows with the columns of `stats`, which has one row for each key; `count` is the number of `rows` with that key.

    Keys with more than 1/share of all rows are fewer than `share`, so their statistics are broadcast and
    their rows stay where they are; all other keys are small and meet by shuffle. Inner join; null keys drop.
    Both inputs are read more than once, so they should be written tables.
    """
    total = stats.agg(F.sum(count)).first()[0] or 0
    frequent = F.broadcast(stats.filter(F.col(count) > total / share))
    rare = stats.filter(F.col(count) <= total / share)
    here = rows.join(frequent, keys)
    there = rows.join(frequent.select(*keys), keys, "left_anti").join(rare, keys)
    return here.unionByName(there)


def few(rows: DataFrame, most: int = FEW) -> DataFrame:
    """A written table that meets others by broadcast if it has no more than `most` rows, else as Spark finds best."""
    return F.broadcast(rows) if rows.count() <= most else rows


def blocks(n: Column, block: int = BLOCK) -> Column:
    """Number of blocks into which `n` rows of a key are cut."""
    return F.greatest(F.lit(1), F.ceil(n / block)).cast("int")


def blocked(rows: DataFrame, row_id: Column, own: Column, other: Column, own_block: str, other_block: str, block: int = BLOCK) -> DataFrame:
    """Rows in one block of their own side, repeated for each block of the other side.

    `own` and `other` are the numbers of rows of the key on both sides. Joined on the key and both blocks, each
    pair of rows meets once, and no key has more than about two blocks of rows.
    """
    placed = rows.withColumn(own_block, F.pmod(F.xxhash64(row_id), blocks(own, block)).cast("int"))
    return placed.withColumn(other_block, F.explode(F.sequence(F.lit(0), blocks(other, block) - 1)))
