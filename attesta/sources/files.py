"""File readers that keep the whole text of a small document in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def whole_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, stem, content): one row per file; malformed content is still a row."""
    files = (
        spark.read.option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))
    )
    return files.select("path", "name", F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"), "content")


def _flat(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return (
        spark.read.option("pathGlobFilter", glob)
        .text(path, wholetext=True)
        .select(F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("day"), F.col("value").alias("content"))
    )


def articles(spark: SparkSession, root: str) -> DataFrame:
    """(day, content) of every <day>.json directly under root."""
    return _flat(spark, root, "20*.json")


def captures(spark: SparkSession, root: str) -> DataFrame:
    """(day, content) of every raw/<day>.json."""
    return _flat(spark, f"{root}/raw", "*.json")


def complete_days(article_df: DataFrame, capture_df: DataFrame) -> DataFrame:
    """Days with both an article and a capture."""
    return article_df.select("day").join(capture_df.select("day"), "day", "left_semi")


def content_days(article_df: DataFrame, capture_df: DataFrame) -> DataFrame:
    """Days with an article, and whether their capture is missing."""
    have = capture_df.select("day").distinct().withColumn("raw_missing", F.lit(False))
    return article_df.select("day").join(have, "day", "left").fillna(True, ["raw_missing"])


def usage_lines(log: DataFrame) -> DataFrame:
    """log(run_id, text) of JSON lines -> the largest token counts seen per run."""
    line = log.select("run_id", F.explode(F.split("text", "\n")).alias("line"))
    event = line.select("run_id", F.try_parse_json("line").alias("e"))
    def seen(*paths):
        return F.coalesce(*[F.try_variant_get("e", p, "long") for p in paths])
    return event.groupBy("run_id").agg(
        F.max(seen("$.usage.input_tokens", "$.input_tokens", "$.usage.prompt_tokens")).alias("tokens_in"),
        F.max(seen("$.usage.output_tokens", "$.output_tokens", "$.usage.completion_tokens")).alias("tokens_out"),
    )
