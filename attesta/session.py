"""Session settings, table access and durable intermediate results."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def build_session(app_name: str = "attesta", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew handling on.

    Shuffle partition count is left to the cluster (AQE coalesces); tests pass their own.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the given Parquet tables. Scans prune columns and push filters down."""
    return spark.read.parquet(f"{root}/{name}.parquet")


_own_folders: dict[str, str] = {}


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; one of our own only if unset.

    Our own folder is for local masters, as in tests, and goes when the process ends; on a cluster it
    would not be shared, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    application = spark.sparkContext.applicationId
    if application not in _own_folders:
        own = tempfile.mkdtemp(prefix="attesta-checkpoint-")
        _own_folders[application] = own
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return _own_folders[application]


_written: dict[str, list[str]] = {}


def fresh_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A new path for a table of our own, which `forget` deletes."""
    path = f"{(folder or checkpoint_folder(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame, name: str = "step", folder: str | None = None, partition_by: str | None = None) -> DataFrame:
    """Write a table several later steps read, and continue from the written copy.

    Cuts the lineage, so nothing upstream runs twice and a lost executor costs only its own
    tasks. A columnar table keeps pruning and sizes, and unlike checkpoint() computes its input
    once. `folder` is where it goes, else the checkpoint folder; `forget` deletes what was written. With
    `partition_by` filters on that column choose what is read.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name, folder)
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> int:
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(paths)


def forget(spark: SparkSession) -> int:
    """Delete the tables this application has written so far; plans that read them are void afterwards."""
    return _delete(spark, _written.pop(spark.sparkContext.applicationId, []))


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside the block go at its end, also after an error; those of outer blocks stay.

    Results have to be written or collected inside the block.
    """
    application = spark.sparkContext.applicationId
    outer = _written.pop(application, [])
    try:
        yield
    finally:
        _delete(spark, _written.pop(application, []))
        _written[application] = outer


def written(build: Callable[[], DataFrame], spark: SparkSession, name: str) -> DataFrame:
    """Write the table that `build` returns, like materialise, and delete the tables `build` wrote on its way."""
    path = fresh_path(spark, name)
    with intermediates(spark):
        df = build()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
