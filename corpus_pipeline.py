"""The corpus pipeline: toxic documents go, repeated lines go, near copies go, leaks go, sources are mixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import decontamination, lines, mixing, queries, shingles, simhash, toxicity
from attesta.session import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, as they are."""
    model = queries.toxicity_model(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score(docs, model) < 0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier, equal or one edit away; emptied ones go."""
    return lines.drop_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates under the contract of op8."""
    return simhash.keep_one(docs)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """After copies by fingerprint, one document of each group linked by a Jaccard similarity of 0.8 over five-word shingles."""
    return shingles.keep_one(materialise(drop_near_copies(spark, docs, sf_dir), "fingerprinted"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document and epoch in which it is read, with the text up to the last token to take of it."""
    rows = docs.select("doc_id", queries.domain(F.col("source")).alias("domain"), "lang", "source", mixing.tokens(F.col("text")).alias("tokens"), "text", "n_chars")
    taken = mixing.select(rows, queries.LEVELS, queries.WEIGHTS, queries.SHARE, queries.MAX_EPOCHS, queries.MIX_SEED, keep=("text", "n_chars"))
    whole = F.col("take") >= F.col("tokens")
    cut = mixing.first_tokens(F.col("text"), F.col("take"))
    n_chars = F.when(whole, F.col("n_chars")).otherwise(F.length(cut).cast(docs.schema["n_chars"].dataType))
    return taken.withColumns({"text": F.when(whole, F.col("text")).otherwise(cut), "n_chars": n_chars})


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_similar),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]

#: Learned scores and near-duplicate components are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
