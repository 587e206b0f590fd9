"""Unattended merge: scope, layering and test judgements, and the gate over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.parsing import glob_to_regex, in_declared_scope
from attesta.functions.vocabulary import (
    EXPECT_NOT_PASS,
    EXPECT_PASS,
    MERGE_CHECKS,
)
from attesta.operators.ranking import top_k


def area(path: Column) -> Column:
    """Top-level directory of a path."""
    return F.substring_index(path, "/", 1)


def parse_log(log: DataFrame) -> DataFrame:
    """`git log --numstat --pretty=@@sha<TAB>subject` text as (sha, subject, path) rows.

    log(text). Each chunk between '@@' headers is one commit, so the islands come from a split
    inside the row instead of a running count over exploded lines.
    """
    chunks = F.split(F.concat(F.lit("\n"), F.regexp_replace("text", r"\r\n?", "\n")), r"\n@@")
    chunk = log.select(F.posexplode(chunks).alias("commit_no", "chunk")).filter("commit_no > 0")
    head = F.substring_index("chunk", "\n", 1)
    rows = F.filter(F.split("chunk", "\n"), lambda line, i: (i > 0) & (F.size(F.split(line, "\t")) >= 3))
    return chunk.select(
        "commit_no",
        F.substring_index(head, "\t", 1).alias("sha"),
        F.when(F.instr(head, "\t") > 0, F.regexp_replace(head, r"^[^\t]*\t", "")).otherwise(F.lit("")).alias("subject"),
        F.explode_outer(F.transform(rows, lambda line: F.split(line, "\t")[2])).alias("path"),
    )


def scope_samples(commits: DataFrame, areas_known: tuple[str, ...], max_per_kind: int = 8) -> DataFrame:
    """Labelled scope samples, one row per sample: kind, expectation and declared areas.

    `areas_known` are the top-level areas tried, in order, for a file that no declared scope contains.

    commits(commit_no, sha, path) in long form. A sample is described by aggregates over its
    paths, so a commit of any size never becomes one array.
    """
    areas = commits.filter("path is not null and path <> ''").select("commit_no", "sha", area(F.col("path")).alias("area"))
    per_commit = areas.groupBy("commit_no", "sha").agg(
        F.min("area").alias("first_area"),
        F.max("area").alias("last_area"),
        *[F.max((F.col("area") == name).cast("int")).alias(f"has_{name}") for name in areas_known],
    )
    foreign = F.coalesce(*[F.when(F.col(f"has_{name}") == 0, F.lit(name)) for name in areas_known])
    several = F.col("first_area") != F.col("last_area")
    options = F.array_compact(
        F.array(
            F.struct(F.lit("legit").alias("kind"), F.lit(EXPECT_PASS).alias("expect"), F.lit(None).cast("string").alias("foreign_area")),
            F.when(several, F.struct(F.lit("scope_extension").alias("kind"), F.lit(EXPECT_NOT_PASS).alias("expect"), F.lit(None).cast("string").alias("foreign_area"))),
            F.when(foreign.isNotNull(), F.struct(F.lit("foreign_file").alias("kind"), F.lit(EXPECT_NOT_PASS).alias("expect"), foreign.alias("foreign_area"))),
        )
    )
    spread = per_commit.select("commit_no", "sha", "first_area", F.explode(options).alias("s")).select("commit_no", "sha", "first_area", "s.*")
    numbered = top_k(spread, max_per_kind, ["kind"], [F.col("commit_no"), F.col("sha")], "number")
    return numbered.withColumn(
        "sample_id", F.concat_ws("-", F.lit("scope"), "kind", F.col("number").cast("string"), F.substring(F.col("sha").cast("string"), 1, 8))
    )


def scope_files(samples: DataFrame, commits: DataFrame) -> DataFrame:
    """(sample_id, path, inside): the changed files of each sample against its declared areas.

    legit and foreign_file declare every touched area; scope_extension only the first one.
    """
    real = commits.filter("path is not null and path <> ''").select("commit_no", "path")
    touched = samples.join(real, "commit_no").select(
        "sample_id",
        "path",
        F.when(F.col("kind") == "scope_extension", area(F.col("path")) == F.col("first_area")).otherwise(F.lit(True)).alias("inside"),
    )
    planted = samples.filter("kind = 'foreign_file'").select(
        "sample_id", F.concat("foreign_area", F.lit("/unrelated-injected-file.py")).alias("path"), F.lit(False).alias("inside")
    )
    return touched.unionByName(planted)


def scope_rule_probability(files: DataFrame) -> DataFrame:
    """1.0 when every changed file is inside the declared areas, else 0.0."""
    return files.groupBy("sample_id").agg(F.min(F.col("inside").cast("int")).cast("double").alias("rule_probability"))


def check_scope(changed: DataFrame, scope: list[str]) -> DataFrame:
    """changed(change_id, path): per change, files outside the scope and the decision."""
    outside = ~in_declared_scope(F.col("path"), scope)
    tally = changed.groupBy("change_id").agg(
        F.count("path").alias("changed"), F.count_if(F.col("path").isNotNull() & outside).alias("outside")
    )
    undecided = (F.col("changed") == 0) | F.lit(not scope)
    return tally.withColumn("check", F.lit("NO_UNINTENDED_SCOPE")).withColumn(
        "decision",
        F.when(undecided, F.lit("cannot_verify")).when(F.col("outside") > 0, F.lit("fail")).otherwise(F.lit("pass")),
    )


def check_architecture(files: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """files(change_id, path, text) against (label, path glob, forbidden regex) rules.

    A file that a rule covers and whose text is missing cannot be verified, so its change does not pass.
    """
    inspected, violated, unread = F.lit(0), F.lit(0), F.lit(0)
    for _, glob, pattern in rules:
        applies = F.col("path").rlike(glob_to_regex(glob)) & ~F.col("path").contains("__pycache__")
        inspected = inspected + applies.cast("int")
        violated = violated + F.coalesce(applies & F.col("text").rlike("(?m)" + pattern), F.lit(False)).cast("int")
        unread = unread + (applies & F.col("text").isNull()).cast("int")
    tally = files.groupBy("change_id").agg(
        F.sum(F.coalesce(inspected, F.lit(0))).alias("inspected"), F.sum(violated).alias("violations"),
        F.sum(F.coalesce(unread, F.lit(0))).alias("_unread"),
    )
    return tally.withColumn("check", F.lit("ARCHITECTURE_OK")).withColumn(
        "decision",
        F.when(F.col("violations") > 0, F.lit("fail"))
        .when((F.col("inspected") == 0) | (F.col("_unread") > 0), F.lit("cannot_verify"))
        .otherwise(F.lit("pass")),
    ).drop("_unread")


def check_tests(output: Column, exit_code: Column) -> Column:
    """Decision from a test runner's output; no summary or zero tests proves nothing."""
    ran = F.regexp_extract(F.coalesce(output, F.lit("")), r"Ran (\d+) tests?", 1)
    return (
        F.when((ran == "") | ran.rlike("^0+$"), F.lit("cannot_verify"))
        .when(exit_code == 0, F.lit("pass"))
        .otherwise(F.lit("fail"))
    )


def merge_gate(checks: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """Per change: merge only when each required check is there once and passed.

    checks(change_id, check, decision); reviews(change_id, merge) is what the artifact claims.
    """
    required = list(MERGE_CHECKS)
    is_required = F.col("check").isin(*required)
    tally = checks.groupBy("change_id").agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(~is_required).alias("unknown"),
        F.count_if(is_required & ~F.coalesce(F.col("decision") == "pass", F.lit(False))).alias("not_passed"),
        *[F.count_if(F.col("check") == name).alias(f"n_{name}") for name in required],
    )
    missing = sum(((F.col(f"n_{n}") == 0).cast("int") for n in required), F.lit(0))
    duplicated = sum(((F.col(f"n_{n}") > 1).cast("int") for n in required), F.lit(0))
    gate = tally.withColumn("missing", missing).withColumn("duplicated", duplicated)
    blocked = (F.col("unknown") + F.col("not_passed") + F.col("missing") + F.col("duplicated")) > 0
    if reviews is not None:
        gate = reviews.select("change_id", "merge").join(gate, "change_id", "left")
        blocked = F.coalesce(blocked, F.lit(True)) | ~F.coalesce(F.col("merge") == "allow", F.lit(False))
    return gate.select(
        "change_id",
        F.coalesce("checks", F.lit(0)).alias("checks"),
        F.coalesce("missing", F.lit(len(required))).alias("missing"),
        F.coalesce("duplicated", F.lit(0)).alias("duplicated"),
        F.coalesce("unknown", F.lit(0)).alias("unknown"),
        F.coalesce("not_passed", F.lit(0)).alias("not_passed"),
        F.when(blocked, F.lit("fail")).otherwise(F.lit("pass")).alias("decision"),
    )
