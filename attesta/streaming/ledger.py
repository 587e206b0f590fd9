"""Incremental upkeep of the run ledger.

The rules are those of the batch ledger: one accepted finished run per (task, target_date), and
the latest row per key wins. A stream applies them per micro-batch against what is already
written, so a replayed batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attesta.operators.ledger import accept_once
from attesta.sources import store


def accept_batch(path: str):
    """foreachBatch writer of accepted runs, partitioned by date and batch.

    A batch reads only the dates it has, and a replayed one overwrites its own partitions. A damaged
    ledger is an error.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        done = None
        if store.exists(batch.sparkSession, path):
            shape = accept_once(batch).schema.add("batch_id", "long")
            done = store.of_days(batch.sparkSession.read.schema(shape).parquet(path), batch).filter(F.col("batch_id") != batch_id)
        new = accept_once(batch, done).withColumn("batch_id", F.lit(batch_id).cast("long"))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("target_date", "batch_id").parquet(path)

    return write


def accept_stream(runs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start accepting finished runs from a stream of run rows until the input is used up."""
    return (
        runs.writeStream.foreachBatch(accept_batch(path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def append_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append ledger events as they come; ledger.fold_events() reads the current rows."""
    return (
        events.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
