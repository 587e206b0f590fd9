"""Merging separately written chunks into one article: ids, caps and citation markers.

Inputs, in long form:
  items(article, group_no, item_no, ...)                        one row per written item
  links(article, group_no, item_no, link_no, local_id, url)     what an item may cite: local_id
      set for a numbered reference of its chunk, NULL for an address cited directly
  index(article, normalised, url)                               captured URLs by normal form
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.functions.urls import legacy_normalise
from attesta.operators.ranking import row_numbers, top_k
from attesta.session import materialise


def capture_index(urls: DataFrame) -> DataFrame:
    """urls(article, position, url) -> the first original URL per normal form."""
    return urls.groupBy("article", legacy_normalise(F.col("url")).alias("normalised")).agg(
        F.min(F.struct("position", "url"))["url"].alias("url")
    )


def place() -> Column:
    """Document order of a link, whatever the numbers of groups, items and links."""
    return F.struct("group_no", "item_no", "link_no")


def resolve_links(links: DataFrame, index: DataFrame) -> DataFrame:
    """Links with the captured URL they stand for; NULL when the capture does not hold it."""
    return (
        links.withColumn("normalised", legacy_normalise(F.col("url")))
        .drop("url")
        .join(index.select("article", "normalised", "url"), ["article", "normalised"], "left")
        .drop("normalised")
    )


def first_seen_ids(resolved: DataFrame) -> DataFrame:
    """(article, url, first_place, global_id): ids in order of first appearance, from 1."""
    first = resolved.filter("url is not null").groupBy("article", "url").agg(F.min(place()).alias("first_place"))
    return row_numbers(first, ["article"], "first_place", "global_id", ties=("url",))


def dropped_citations(resolved: DataFrame) -> DataFrame:
    """Distinct references per article that the capture cannot confirm."""
    return (
        resolved.filter("url is null")
        .select("article", "group_no", "local_id", F.when(F.col("local_id").isNull(), F.struct("item_no", "link_no")).alias("direct"))
        .distinct()
        .groupBy("article")
        .agg(F.count(F.lit(1)).alias("dropped_citations"))
    )


def supported_items(items: DataFrame, cited: DataFrame) -> DataFrame:
    """Items that keep at least one verifiable source."""
    keys = ["article", "group_no", "item_no"]
    return items.join(cited.select(*keys).distinct(), keys, "left_semi")


def cap_items(items: DataFrame, cap: int) -> DataFrame:
    """At most `cap` items per article, taken in turns across its groups.

    No group gives more than `cap`, so the second window sees at most groups * cap rows.
    """
    turns = top_k(items, cap, ["article", "group_no"], [F.col("item_no")], "turn")
    return top_k(turns, cap, ["article"], [F.col("turn"), F.col("group_no")], "pick").drop("turn")


def final_ids(resolved: DataFrame, used: DataFrame) -> DataFrame:
    """Used citations with `final_id`: dense ids of the references still cited, by first appearance.

    Numbering what is left by first appearance gives the same ids as numbering everything and
    closing the gaps afterwards. What an article uses is bounded by its cap, so its references are
    numbered where they meet.
    """
    first = resolved.filter("url is not null").groupBy("article", "url").agg(F.min(place()).alias("first_place"))
    dense = F.dense_rank().over(W.partitionBy("article").orderBy("first_place", "url")).cast("long")
    return used.join(first, ["article", "url"]).withColumn("final_id", dense)


def merge(items: DataFrame, links: DataFrame, index: DataFrame, cap: int = 20) -> tuple[DataFrame, DataFrame]:
    """(kept items, their final citations) of every article."""
    resolved = materialise(resolve_links(links, index), "links")
    cited = resolved.filter("url is not null")
    kept = cap_items(supported_items(items, cited), cap)
    keys = ["article", "group_no", "item_no"]
    used = cited.join(kept.select(*keys), keys, "left_semi")
    citations = final_ids(resolved, used).select(*keys, "local_id", "url", "final_id")
    return kept, citations.distinct()


def bilingual_pair(value: Column) -> Column:
    """A block as struct<zh,en>; a plain text stands for both languages. `value` is VARIANT."""
    kind = F.schema_of_variant(value)
    text = F.when(kind == "STRING", value.try_cast("string"))
    zh = F.coalesce(text, F.try_variant_get(value, "$.zh", "string"), F.lit(""))
    en = F.coalesce(text, F.try_variant_get(value, "$.en", "string"), F.lit(""))
    return F.struct(zh.alias("zh"), en.alias("en"))
