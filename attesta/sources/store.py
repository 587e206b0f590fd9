"""The ledger as a table: a snapshot partitioned by day, kept up by folding in what changed."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators.ledger import fold_events
from attesta.session import materialise

DAY = "target_date"


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def decoded(rows: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """JSON text columns as VARIANT ones, given as {text column: new name}; text that is no JSON is NULL."""
    return rows.select("*", *[F.try_parse_json(text).alias(name) for text, name in columns.items()]).drop(*columns)


def of_days(rows: DataFrame, days: DataFrame, day: str = DAY) -> DataFrame:
    """The rows of the given days, as a filter on the partition column; a batch has few days, which bounds the list."""
    wanted = [r[0] for r in days.select(day).distinct().collect()]
    return rows.filter(F.col(day).isin([d for d in wanted if d is not None]) | (F.col(day).isNull() if None in wanted else F.lit(False)))


def update(path: str, events: DataFrame, keys: list[str], order: list[str], day: str = DAY) -> None:
    """Fold newer rows into the snapshot at `path`. Only partitions of days that the events name are read and written.

    A key keeps its day. The folded rows are written aside first, so the partitions are not read while they are
    replaced; doing it again after a failure gives the same table.
    """
    spark = events.sparkSession
    rows = events
    if exists(spark, path):
        held = spark.read.schema(events.schema).parquet(path)  # days that look like dates keep their type
        rows = of_days(held, events, day).select(*events.columns).unionByName(events)
    folded = materialise(fold_events(rows, [*keys, day], order).select(*events.columns), "folded")
    folded.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def current(snapshot: DataFrame, tail: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Current rows of a snapshot and newer events not yet folded in; only keys of the tail are folded."""
    own = tail.select(*keys).distinct()
    changed = snapshot.join(own, keys, "left_semi").select(*tail.columns).unionByName(tail)
    return snapshot.join(own, keys, "left_anti").select(*tail.columns).unionByName(fold_events(changed, keys, order).select(*tail.columns))


def get_runs(snapshot: DataFrame, wanted: DataFrame, key: str = "run_id", day: str = DAY) -> DataFrame:
    """Whole rows of the wanted (run_id, target_date); other days' partitions are not read."""
    return of_days(snapshot, wanted, day).join(wanted.select(key, day).distinct(), [key, day], "left_semi")
