"""Selection quality: a balanced sheet to label, and its score once labelled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.decisions import rate
from attesta.operators.ranking import interleave, top_k

SHEET_COLUMNS = (
    "case_id", "day", "bucket", "title", "url", "section", "group", "kind", "signal",
    "draft", "draft_reason", "gold", "note",
)


def score_sheet(sheet: DataFrame) -> DataFrame:
    """Per day and in total (day NULL): tp, fp, fn, tn, precision, recall, accuracy.

    sheet(day, bucket, gold). Only gold 'select' and 'reject' count; 'either' and blanks do not.
    """
    gold = F.lower(F.trim(F.coalesce("gold", F.lit(""))))
    wanted, chosen = gold == "select", F.coalesce(F.col("bucket") == "selected", F.lit(False))
    unwanted = gold == "reject"
    counts = sheet.groupingSets([[F.col("day")], []], F.col("day")).agg(
        F.count(F.lit(1)).alias("sheet_rows"),
        F.count_if(wanted | unwanted).alias("labelled"),
        F.count_if(gold == "either").alias("either"),
        F.count_if(wanted & chosen).alias("tp"),
        F.count_if(unwanted & chosen).alias("fp"),
        F.count_if(wanted & ~chosen).alias("fn"),
        F.count_if(unwanted & ~chosen).alias("tn"),
        F.grouping("day").alias("is_total"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (
        counts.withColumn("precision", rate(tp, tp + fp, 6))
        .withColumn("recall", rate(tp, tp + fn, 6))
        .withColumn("accuracy", rate(tp + tn, tp + fp + fn + tn, 6))
    )


def shuffle_key(seed: str, key: Column) -> Column:
    """A reproducible random order that needs no driver and no sequence of draws."""
    return F.sha2(F.concat_ws("|", F.lit(seed), key.cast("string")), 256)


def build_sheet(selected: DataFrame, unselected: DataFrame, sample: int = 100, seed: str = "selection") -> DataFrame:
    """Half published, half skipped, in shuffled alternation; both inputs have a unique `key`.

    Each side gives at most `sample` rows by hash order (a top-k), which bounds the rest.
    """
    def first(df: DataFrame, bucket: str) -> DataFrame:
        tagged = df.withColumn("bucket", F.lit(bucket)).withColumn("_h", shuffle_key(seed, F.col("key")))
        return top_k(tagged, sample, ["bucket"], [F.col("_h"), F.col("key")], "n").drop("_h")

    left, right = first(selected, "selected"), first(unselected, "unselected")
    left = left.filter(F.col("n") <= sample // 2)
    taken = left.agg(F.count(F.lit(1)).alias("taken"))
    right = right.crossJoin(F.broadcast(taken)).filter(F.col("n") <= sample - F.col("taken")).drop("taken")
    both = interleave(left, right, "n")
    side = F.when(F.col("bucket") == "selected", F.lit(0)).otherwise(F.lit(1))
    from pyspark.sql import Window as W

    numbered = both.withColumn("case_no", F.row_number().over(W.orderBy("n", side)))
    return numbered.withColumn("case_id", F.format_string("sel-%s-%03d", F.col("day").cast("string"), F.col("case_no")))


def unselected_candidates(rows: DataFrame, used: DataFrame, k: int = 25, feeds: DataFrame | None = None) -> DataFrame:
    """High-signal capture rows the article did not reference: top k per day and bucket, then anti-join.

    `feeds` (capture.feed_rows) join them as buckets named feed:<name>, ranked in feed order.
    """
    order = [F.desc(F.coalesce("signal_number", F.lit(0.0))), F.desc(F.coalesce("signal_text", F.lit(""))), F.asc("position")]
    ranked = top_k(rows, k, ["day", "bucket"], order, "rank_in_source")
    if feeds is not None:
        listed = feeds.withColumn("bucket", F.concat(F.lit("feed:"), F.col("feed"))).withColumn("rank_in_source", F.col("position") + 1)
        ranked = ranked.select("day", "bucket", "title", "url", "rank_in_source").unionByName(
            listed.filter(F.col("rank_in_source") <= k).select("day", "bucket", "title", "url", "rank_in_source")
        )
    trimmed = ranked.withColumn("url", F.regexp_replace(F.coalesce("url", F.lit("")), "/+$", "")).filter("url <> ''")
    return trimmed.join(used.select("day", "url").distinct(), ["day", "url"], "left_anti")
