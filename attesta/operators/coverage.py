"""What the capture ranked high and the article left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.urls import canonical_url, path_only, strip, strip_arxiv_version
from attesta.operators.ranking import top_k


def ranked_pool(rows: DataFrame, k: int = 10) -> DataFrame:
    """Top k rows per day and bucket by that bucket's own signal, with rank_in_source.

    rows(day, bucket, source, position, title, url, text, date, signal_number, signal_text).
    Numbers rank descending (missing is 0), texts (ISO times, HH:MM) descending; ties keep the
    capture order. Rows are filtered after ranking: an empty address, a post of another day, or
    a short or link-only post leaves a gap in the ranks.
    """
    order = [
        F.desc(F.coalesce("signal_number", F.lit(0.0))),
        F.desc(F.coalesce("signal_text", F.lit(""))),
        F.asc("position"),
    ]
    ranked = top_k(rows, k, ["day", "bucket"], order, "rank_in_source")
    post = F.col("bucket").startswith("tweets")
    text = strip(F.col("text"))
    off_window = post & (F.coalesce("date", F.lit("")) != "") & (F.col("date") != F.col("day").cast("string"))
    thin = post & ((F.length(text) < 40) | F.lower(text).startswith("http") | F.lower(text).startswith("excited http"))
    return (
        ranked.withColumn("url", strip(F.col("url")))
        .filter(F.col("url") != "")
        .withColumn("off_window", F.coalesce(off_window, F.lit(False)))
        .filter(F.col("off_window") | ~F.coalesce(thin, F.lit(False)))
    )


def mark_covered(pool: DataFrame, cited: DataFrame) -> DataFrame:
    """Pool rows with `covered`. cited(day, canonical) must be distinct.

    A row is covered when the article cites the same canonical URL, the same paper in another
    version, the same path with a query, or the bare path of a pool URL that has a query.
    """
    aimed = pool.withColumn("target", canonical_url(F.col("url")))
    hits = cited.select("day", "canonical", F.lit(True).alias("hit"))
    with_query = cited.filter(F.instr("canonical", "?") > 0).select(
        "day", path_only(F.col("canonical")).alias("target"), F.lit(True).alias("hit_query")
    ).distinct()
    # Every address under which a pool row may have been cited, matched in one equi join.
    names = F.array_distinct(
        F.array(F.col("target"), strip_arxiv_version(F.col("target")), path_only(F.col("target")))
    )
    found = (
        aimed.select("day", "target", F.explode(names).alias("canonical"))
        .distinct()
        .join(hits, ["day", "canonical"])
        .groupBy("day", "target")
        .agg(F.max("hit").alias("hit_name"))
    )
    return (
        aimed.join(found, ["day", "target"], "left")
        .join(with_query, ["day", "target"], "left")
        .withColumn(
            "covered",
            F.coalesce("hit_name", F.lit(False))
            | (F.coalesce("hit_query", F.lit(False)) & (F.instr("target", "?") == 0)),
        )
        .drop("hit_name", "hit_query")
    )


def on_topic(text: Column, keywords: list[str] | None) -> Column:
    """Keyword match; NULL when no profile is available, which is not the same as off topic."""
    if not keywords:
        return F.lit(None).cast("boolean")
    hit = F.lit(False)
    for word in keywords:
        hit = hit | F.lower(text).contains(word.lower())
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit(False)).otherwise(hit)


def misses(covered: DataFrame) -> DataFrame:
    """Uncovered rows with their place in the day's list: on topic first, then rank, then source."""
    from pyspark.sql import Window as W

    order = W.partitionBy("day").orderBy(
        F.when(F.coalesce("on_topic", F.lit(False)), 0).otherwise(1), "rank_in_source", "source", "bucket"
    )
    # A day's pool holds at most k rows per bucket, which bounds this window.
    return covered.filter(~F.col("covered") & ~F.col("off_window")).withColumn("miss_no", F.row_number().over(order))


def coverage_gate(covered: DataFrame) -> DataFrame:
    """Per day: pool size, misses and top-three misses. Advisory: the decision is always pass."""
    inside = ~F.col("off_window")
    missed = inside & ~F.col("covered")
    topic = F.coalesce("on_topic", F.lit(False))
    tally = covered.groupBy("day").agg(
        F.count_if(inside).alias("pool"),
        F.count_if(missed).alias("missed"),
        F.count_if(missed & (F.col("rank_in_source") <= 3)).alias("top3_missed_all"),
        F.count_if(missed & topic & (F.col("rank_in_source") <= 3)).alias("top3_missed"),
        F.count_if(missed & topic).alias("missed_on_topic"),
        F.count_if(~inside).alias("off_window_dropped"),
    )
    ratio = F.when(F.col("pool") > 0, F.bround((F.col("pool") - F.col("missed")) / F.col("pool"), 3))
    return tally.withColumn("pool_coverage_ratio", ratio).withColumn("decision", F.lit("pass"))
