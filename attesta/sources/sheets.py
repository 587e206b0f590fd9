"""Sinks and their readers: corpora, labelling sheets, baselines, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators.selection import SHEET_COLUMNS


def save_corpus(samples: DataFrame, path: str, fmt: str = "json") -> None:
    samples.write.mode("overwrite").format(fmt).save(path)


def load_corpus(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    if fmt == "json":
        return spark.read.schema("sample_id string, kind string, url string, day string, expect string, note string").json(path)
    return spark.read.format(fmt).load(path)


def write_sheet(sheet: DataFrame, path: str) -> None:
    """The sheet as JSON lines and as CSV with a header."""
    present = [c for c in SHEET_COLUMNS if c in sheet.columns]
    text = sheet.selectExpr(*[f"cast(`{c}` as string) as `{c}`" for c in present])
    text.write.mode("overwrite").json(f"{path}/jsonl")
    text.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(f"{path}/csv")


def load_sheet(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """A sheet as it was written or filled in; every column is text."""
    schema = ", ".join(f"`{c}` string" for c in SHEET_COLUMNS)
    if fmt == "csv":
        return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return spark.read.schema(schema).json(path)


def freeze_baseline(report: DataFrame, path: str) -> None:
    """matcher, fingerprint, rates: the frozen side of check_baseline()."""
    report.select("matcher", "fingerprint", "samples", "false_pass_rate", "false_fail_rate").write.mode("overwrite").parquet(path)


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    """The frozen side of check_baseline(); a baseline that is not there is an error, not an empty one."""
    shape = "matcher string, fingerprint string, samples long, false_pass_rate double, false_fail_rate double"
    return spark.read.schema(shape).parquet(path)


def save_verdicts(verdicts: DataFrame, path: str) -> None:
    """Per-sample probabilities of judge and rule: re-scoring needs no second judge call."""
    verdicts.select("sample_id", "kind", "expect", "probability", "rule_probability").write.mode("overwrite").parquet(path)


def save_report(verdicts: DataFrame, fingerprint: str, path: str) -> None:
    """A nested report as JSON lines: each sample with its probabilities, bound to the corpus's fingerprint."""
    sample = F.struct("sample_id", "kind", "expect").alias("sample")
    probability = F.struct(F.col("probability").alias("judge"), F.col("rule_probability").alias("rule")).alias("probability")
    line = F.to_json(F.struct(F.lit(fingerprint).alias("corpus"), sample, probability))
    verdicts.select(line.alias("value")).write.mode("overwrite").text(path)


def load_report(spark: SparkSession, path: str, fingerprint: str) -> DataFrame:
    """Samples and probabilities of a saved report, for scoring without new judge calls.

    Lines are read as VARIANT. A line that cannot be read, or belongs to another corpus, is an error.
    """
    doc = F.try_parse_json("value")
    own = F.try_variant_get(doc, "$.corpus", "string") == fingerprint
    checked = spark.read.text(path).select(F.when(own, doc).otherwise(F.raise_error(F.lit("not a report of this corpus")).cast("variant")).alias("doc"))
    fields = [("sample.sample_id", "string"), ("sample.kind", "string"), ("sample.expect", "string"), ("probability.judge", "double"), ("probability.rule", "double")]
    names = ["sample_id", "kind", "expect", "probability", "rule_probability"]
    return checked.select(*[F.try_variant_get("doc", f"$.{where}", kind).alias(name) for (where, kind), name in zip(fields, names)])


def write_report(report: DataFrame, path: str) -> None:
    """A report table as JSON and CSV."""
    report.write.mode("overwrite").json(f"{path}/json")
    flat = [c for c, kind in report.dtypes if not kind.startswith(("array", "map", "struct"))]
    report.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def markdown(report: DataFrame, most: int = 10_000) -> str:
    """A whole report as a Markdown table; one of more than `most` rows is refused, not cut."""
    names = report.columns
    rows = report.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows is not a page: use write_report")
    cell = lambda v: "-" if v is None else str(v).replace("|", "/")
    head = ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
    return "\n".join(head + ["| " + " | ".join(cell(v) for v in row) + " |" for row in rows])
