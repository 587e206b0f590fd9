"""Matching strings that start with each other, as one sort-merge join.

A `startswith` join plans as a nested loop over all pairs. Sorted, a string stands behind its prefixes
and before what continues it, so one pass with a stack of the strings that are still open answers both
questions. Both sides are sorted together, cut into ranges; each string is shuffled twice, however long
it is. Strings that are open where a range begins travel there as guests.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.operators.openings import GUEST, KNOWN, TARGET, Stack
from attesta.session import materialise

def nearest(targets: DataFrame, text: str, known: DataFrame) -> DataFrame:
    """(day, text, extends, truncates) for targets with either.

    `extends` is the longest known string of the day that the target continues, `truncates` the longest,
    then first by name, that continues the target. Equal strings are no match; nulls match nothing. Both
    inputs are distinct.

    A table of sorted ranges is written. Its first strings, one for each range, say which strings are still
    open in later ranges: those that the first string of the range continues. A target that is open in
    several ranges gets its best from each of them.
    """
    names = known.select("day", F.col("canonical").alias("text"), F.lit(KNOWN).alias("kind"))
    asked = targets.select("day", F.col(text).alias("text"), F.lit(TARGET).alias("kind"))
    rows = names.unionByName(asked).dropna()
    ranges = materialise(rows.repartitionByRange("day", "text").withColumn("part", F.spark_partition_id()), "ranges")
    borders = [
        (r["part"], r["first"]["day"], r["first"]["text"])
        for r in ranges.groupBy("part").agg(F.min(F.struct("day", "text")).alias("first")).orderBy("part").collect()  # one for each range
    ]
    whole = ranges
    if len(borders) > 1:
        schema = f"at int, b_day {rows.schema['day'].dataType.simpleString()}, first string"
        after = [(here[0], *there[1:]) for here, there in zip(borders, borders[1:])]
        opened = ranges.join(F.broadcast(rows.sparkSession.createDataFrame(after, schema)), F.col("part") == F.col("at"))
        guests = opened.filter((F.col("day") == F.col("b_day")) & F.col("first").startswith(F.col("text")))
        first = F.broadcast(rows.sparkSession.createDataFrame(borders, schema).withColumnRenamed("at", "later"))
        # Few rows: at most as many for each border as its text has characters.
        placed = guests.drop("at", "b_day", "first").join(first, (F.col("day") == F.col("b_day")) & (F.col("later") > F.col("part")) & F.col("first").startswith(F.col("text")))
        whole = ranges.unionByName(placed.select("day", "text", F.col("kind").bitwiseOR(GUEST).alias("kind"), F.col("later").alias("part")))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, now = Stack(), None
        kind = None

        def result() -> pa.RecordBatch:
            texts, extends, truncates, days = [], [], [], []
            for day, done in finished:
                for t, e, b in done:
                    days.append(day), texts.append(t), extends.append(e), truncates.append(b)
            finished.clear()
            return pa.RecordBatch.from_arrays([pa.array(days, kind), *[pa.array(v, pa.string()) for v in (texts, extends, truncates)]], ["day", "text", "extends", "truncates"])

        finished: list[tuple[object, list]] = []
        for batch in batches:
            kind = batch.column(1).type
            for part, day, string, what in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (part, day) != now:
                    stack.close()
                    finished.append((now and now[1], stack.done))
                    stack, now = Stack(), (part, day)
                stack.meet(string, what)
            if stack.done:
                finished.append((now[1], stack.done))
                stack.done = []
            if finished:
                yield result()
        if kind is not None:
            stack.close()
            finished.append((now[1], stack.done))
            yield result()

    sorted_rows = whole.repartition("part").select("part", "day", "text", "kind").sortWithinPartitions("part", "day", "text", "kind")
    day = rows.schema["day"].dataType.simpleString()
    found = sorted_rows.mapInArrow(merged, f"day {day}, text string, extends string, truncates string")
    best = F.min(F.when(F.col("truncates").isNotNull(), F.struct((-F.length("truncates")).alias("n"), F.col("truncates").alias("name"))))
    return found.groupBy("day", F.col("text").alias(text)).agg(F.max("extends").alias("extends"), best["name"].alias("truncates"))


def nearest_extended(targets: DataFrame, text: str, known: DataFrame, shortest: int) -> DataFrame:
    """(day, text, real): for each target the longest known string of at least `shortest` characters that it continues."""
    found = nearest(targets, text, known.filter(F.length("canonical") >= shortest))
    return found.filter("extends is not null").select("day", text, F.col("extends").alias("real"))


def nearest_continuing(targets: DataFrame, text: str, known: DataFrame, shortest: int) -> DataFrame:
    """(day, text, real): for each target of at least `shortest` characters the known string that continues it, the longest, then first by name."""
    found = nearest(targets.filter(F.length(text) >= shortest), text, known)
    return found.filter("truncates is not null").select("day", text, F.col("truncates").alias("real"))
