"""Evidence tables derived from the given tables. Every derivation covers the whole table.

Days are numbers: pages are captured in blocks of 100 page ids, so the number of days grows
with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.text import first_line
from attesta.functions.urls import (
    attack_extension,
    attack_suffix,
    canonical_url,
    path_only,
    rotated_drift,
)
from attesta.operators.provenance import known_urls
from attesta.session import table

PAGES_PER_DAY = 100

#: A reader's profile: words that make an item worth reading, words that exclude it, and signals of depth.
PROFILE = {
    "interest": ("tion", "ung", "ment", "ción", "ing"),
    "exclude": ("!!", "%%%"),
    "mechanism": ("通过", "采用", "实现", "机制", "because", "by ", "using"),
    "limit": ("限制", "不足", "仅在", "但", "however", "only", "limit"),
}


def captured(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "pages").select("page_id", F.expr(f"page_id div {PAGES_PER_DAY}").alias("day"), "url")


def known(spark: SparkSession, root: str) -> DataFrame:
    return known_urls(captured(spark, root))


def citations(spark: SparkSession, root: str) -> DataFrame:
    """Six citations of every page: a drifted one on its day, the plain one a day late, two with
    an invented remainder, the bare path, and the address cut by one segment."""
    def form(no: int, name: str, day, url):
        return F.struct(F.lit(no).alias("no"), F.lit(name).alias("form"), day.alias("day"), url.alias("url"))

    plain = captured(spark, root).withColumn("canonical", canonical_url(F.col("url")))
    day, url, canonical = F.col("day"), F.col("url"), F.col("canonical")
    forms = F.array(
        form(0, "drift", day, rotated_drift(url, F.col("page_id"))["url"]),
        form(1, "late", day + 1, url),
        form(2, "extension", day, attack_extension(canonical)),
        form(3, "suffix", day, attack_suffix(canonical)),
        form(4, "bare", day, path_only(url)),
        form(5, "cut", day, F.concat(F.lit("https://"), F.regexp_replace(canonical, "/[^/]*$", ""))),
    )
    return plain.select("page_id", F.explode(forms).alias("c")).select(
        (F.col("page_id") * 6 + F.col("c.no")).alias("cite_id"), "c.form", "c.day", "c.url"
    )


def article_citations(spark: SparkSession, root: str) -> DataFrame:
    """(day, position, url): what the article of each day cites, in order."""
    return (
        table(spark, root, "pages")
        .select(F.expr(f"page_id div {PAGES_PER_DAY}").alias("day"), F.col("page_id").alias("position"), "url")
    )


def dedup_candidates(spark: SparkSession, root: str) -> DataFrame:
    """Documents as entries: source is the article, language the section, the first line the
    title, the whole text the body; the last line stands for the cited page."""
    docs = table(spark, root, "documents")
    last = F.substring_index("text", "\n", -1)
    return docs.select(
        F.col("source").alias("article"),
        F.col("doc_id").alias("rank"),
        F.col("doc_id").cast("string").alias("location"),
        F.col("lang").alias("section"),
        F.lit("").alias("title_zh"),
        first_line(F.col("text")).alias("title_en"),
        F.lit("").alias("body_zh"),
        F.col("text").alias("body_en"),
        F.array(F.concat(F.lit("https://docs.example/"), F.md5(last))).alias("urls"),
    )


def judged_samples(spark: SparkSession, root: str) -> DataFrame:
    """Labelled documents as samples: the judge's probability is the share of distinct words in
    the whole text and it abstains on toxic ones; the rule decides by length and abstains between."""
    docs = table(spark, root, "documents").select("doc_id", "text", "lang", "n_chars")
    words = F.filter(F.split("text", "[ \n]+"), lambda w: w != "")
    share = F.bround(F.size(F.array_distinct(words)) / F.size(words), 4)
    return (
        table(spark, root, "labels")
        .join(docs, "doc_id")
        .select(
            F.col("doc_id").alias("sample_id"),
            F.col("lang").alias("kind"),
            F.when(F.col("quality") == 1, F.lit("pass")).otherwise(F.lit("not_pass")).alias("expect"),
            F.when(F.col("toxic") == 0, share).alias("probability"),
            F.when(F.col("n_chars") >= 1000, F.lit(1.0)).when(F.col("n_chars") < 300, F.lit(0.0)).alias("rule_probability"),
        )
    )


def runs(spark: SparkSession, root: str) -> DataFrame:
    """Events as run records: the type gives the status, the user the task, k the tokens."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    status = (
        F.when(kind == "view", "success").when(kind == "click", "degraded").when(kind == "signup", "running")
        .when(kind == "purchase", "failed").otherwise("crashed")
    )
    return table(spark, root, "events").select(
        F.col("event_id").alias("run_id"),
        F.col("user_id").alias("task"),
        F.to_date("ts").alias("target_date"),
        F.col("ts").alias("started_at"),
        (F.col("ts") + F.make_interval(secs=k)).alias("finished_at"),
        status.alias("status"),
        (k < 10).alias("dry_run"),
        k.alias("tokens_in"),
        (k * 2).alias("tokens_out"),
        (k * 1000).alias("duration_ms"),
        (kind == "error").alias("human_intervention"),
        F.when(kind != "error", F.col("value")).alias("cost_usd"),
        F.concat_ws("-", F.lit("exp"), kind).alias("experiment"),
        F.col("user_id").alias("pid"),
    )
