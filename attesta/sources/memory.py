"""Markdown memory entries with front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.text import first_heading, slugify
from attesta.sources.files import whole_texts


def parse_entries(files: DataFrame) -> DataFrame:
    """files(path, stem, content) -> path, kind, task, date, tags, title, source, body."""
    head = F.regexp_extract("content", r"(?s)\A---\n(.*?)\n---", 1)
    has_head = F.col("content").rlike(r"(?s)\A---\n.*?\n---")
    body = F.when(has_head, F.regexp_replace("content", r"(?s)\A---\n.*?\n---\n*", "")).otherwise(F.col("content"))
    pairs = F.filter(F.split(head, "\n"), lambda line: F.instr(line, ":") > 0)

    def value(name: str) -> Column:
        mine = F.filter(pairs, lambda line: F.trim(F.substring_index(line, ":", 1)) == name)
        last = F.try_element_at(mine, F.lit(-1))
        return F.coalesce(F.trim(F.regexp_replace(last, "^[^:]*:", "")), F.lit(""))

    folder = F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1)
    tags = F.filter(F.transform(F.split(value("tags"), ","), lambda t: F.trim(t)), lambda t: t != "")
    heading = first_heading(body)
    title = (
        F.when(value("title") != "", value("title")).when(heading != "", heading).otherwise(F.col("stem"))
    )
    return files.select(
        "path",
        F.when(folder.isin("runs", "notes"), folder).otherwise(F.lit("other")).alias("kind"),
        value("task").alias("task"),
        value("date").alias("date"),
        tags.alias("tags"),
        title.alias("title"),
        value("source").alias("source"),
        body.alias("body"),
    )


def read_entries(spark: SparkSession, root: str) -> DataFrame:
    return parse_entries(whole_texts(spark, root, "*.md"))


def note_rows(notes: DataFrame) -> DataFrame:
    """notes(title, body, tags, source, date, task) as entry rows with the path they belong at."""
    path = F.concat(F.lit("notes/"), "date", F.lit("-"), slugify(F.col("title")), F.lit(".md"))
    return notes.select(path.alias("path"), F.lit("notes").alias("kind"), "task", "date", "tags", "title", "source",
                        F.concat(F.lit("# "), "title", F.lit("\n\n"), F.trim("body"), F.lit("\n")).alias("body"))


def run_rows(runs: DataFrame) -> DataFrame:
    """runs(run_id, task, target_date, status, summary) as factual entry rows."""
    title = F.concat_ws(" · ", "task", "target_date", "status")
    return runs.select(
        F.concat(F.lit("runs/"), "run_id", F.lit(".md")).alias("path"), F.lit("runs").alias("kind"), "task",
        F.col("target_date").alias("date"), F.array("task", "status").alias("tags"), title.alias("title"),
        F.lit("").alias("source"),
        F.concat(F.lit("# "), title, F.lit("\n\n"), F.trim("summary"), F.lit("\n")).alias("body"),
    )


def promote_runs(runs: DataFrame, promoted: DataFrame) -> DataFrame:
    """promoted(run_id, title) of recorded runs as note rows that name their run."""
    facts = F.concat_ws(
        "\n",
        F.concat(F.lit("- task: "), "task", F.lit(" ("), F.col("target_date").cast("string"), F.lit(")")),
        F.concat(F.lit("- status: "), "status"),
    )
    return note_rows(
        promoted.join(runs, "run_id").select(
            "title", facts.alias("body"), F.array("task", F.lit("promoted")).alias("tags"),
            F.concat(F.lit("run:"), "run_id").alias("source"), F.col("target_date").cast("string").alias("date"), "task",
        )
    )
