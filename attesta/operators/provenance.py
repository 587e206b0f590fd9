"""Does a cited URL trace back to what was captured that day?

Inputs:  citations(day, url, ...)   known(day, canonical) distinct
The ladder works on distinct (day, target) pairs with equi joins; targets the first one settles
are not expanded for the others. Verdicts are joined back to the citations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.urls import (
    canonical_url,
    legacy_normalise,
    path_only,
    strip_arxiv_version,
)
from attesta.functions.vocabulary import MIN_PREFIX_LENGTH
from attesta.operators.prefix import nearest
from attesta.session import materialise

# Result of a rung: decision, reason, failure class, drift.
_RUNGS = {
    "malformed": ("fail", "empty url", "malformed", None),
    "exact": ("pass", "exact match", None, None),
    "arxiv": ("pass", "arxiv version drift", None, "arxiv_version"),
    "query": ("pass", "fetched url carries extra query parameters", None, "query_suffix"),
    "extends": ("cannot_verify", "cited url extends a fetched url", "unknown_variant", None),
    "truncates": ("cannot_verify", "cited url truncates a fetched url", "unknown_variant", None),
    "none": ("fail", "no fetched url matches", "fabricated_source", None),
}


def known_urls(capture: DataFrame, url: str = "url") -> DataFrame:
    """Distinct canonical URLs per day."""
    return capture.select("day", canonical_url(F.col(url)).alias("canonical")).distinct()


def _pick(index: int) -> Column:
    value = F.lit(None).cast("string")
    for rung, fields in _RUNGS.items():
        value = F.when(F.col("rung") == rung, F.lit(fields[index]).cast("string")).otherwise(value)
    return value


def classify_targets(
    targets: DataFrame, known: DataFrame, min_length: int = MIN_PREFIX_LENGTH
) -> DataFrame:
    """(day, target) -> rung and matched URL. `targets` must be distinct and already canonical.

    The first join settles equality, paper versions and extra query parameters together; captured
    URLs that share a bare path are one row there, the best of them. Only targets it leaves open are
    matched by prefix. The best rung wins, then the longest captured URL, then the first by name.
    """
    has_query = F.instr("target", "?") > 0
    stripped = strip_arxiv_version(F.col("target"))
    keys = F.array_compact(
        F.array(
            F.struct(F.lit("t").alias("as"), F.col("target").alias("key")),
            F.when(stripped != F.col("target"), F.struct(F.lit("v").alias("as"), stripped.alias("key"))),
        )
    )
    bare = path_only(F.col("canonical"))
    names = F.array_compact(
        F.array(
            F.struct(F.lit(False).alias("cut"), F.col("canonical").alias("key")),
            F.when(bare != F.col("canonical"), F.struct(F.lit(True).alias("cut"), bare.alias("key"))),
        )
    )
    # The best of each key is picked before the join; the aggregate combines in the map tasks.
    named = (
        known.select("day", "canonical", F.explode(names).alias("n"))
        .groupBy("day", F.col("n.key").alias("key"), F.col("n.cut").alias("cut"))
        .agg(F.min(F.struct((-F.length("canonical")).alias("n"), "canonical")).alias("b"))
        .select("day", "key", "cut", "b.canonical")
    )
    joined = (
        targets.select("day", "target", F.explode(keys).alias("k"))
        .select("day", "target", "k.*")
        .join(named, ["day", "key"], "left")
    )
    rung = (
        F.when(F.col("target") == "", F.lit("0malformed"))
        .when(F.col("canonical").isNull(), F.lit(None).cast("string"))
        .when((F.col("as") == "t") & ~F.col("cut"), F.lit("1exact"))
        .when((F.col("as") == "v") & ~F.col("cut"), F.lit("2arxiv"))
        .when((F.col("as") == "t") & ~has_query, F.lit("3query"))
    )
    ranked = F.struct(rung.alias("rung"), (-F.length("canonical")).alias("n"), F.col("canonical").alias("matched"))
    settled = joined.groupBy("day", "target").agg(F.min(F.when(rung.isNotNull(), ranked)).alias("best")).select(
        "day", "target", F.substring("best.rung", 2, 20).alias("rung"), "best.matched",
        F.col("best").isNull().alias("open"),
    )
    settled = materialise(settled, "settled")
    open_targets = settled.filter("open").select("day", "target")
    near = nearest(open_targets.filter("target <> ''"), "target", known.filter(F.length("canonical") >= min_length))
    closest = F.least(*[
        F.when(F.col(way).isNotNull(), F.struct((-F.length(way)).alias("n"), F.col(way).alias("matched"), F.lit(way).alias("rung")))
        for way in ("extends", "truncates")
    ])
    final = settled.join(near, ["day", "target"], "left").withColumn("near", closest)
    return final.select(
        "day", "target",
        F.coalesce("rung", "near.rung", F.lit("none")).alias("rung"),
        F.when(F.col("rung") != "malformed", F.col("matched")).when(F.col("rung").isNull(), F.col("near.matched")).alias("matched"),
    )


def classify_citations(citations: DataFrame, known: DataFrame, min_length: int = MIN_PREFIX_LENGTH) -> DataFrame:
    """Citations with target, decision, reason, failure_class, drift and matched URL."""
    aimed = citations.withColumn("target", canonical_url(F.col("url")))
    verdicts = classify_targets(aimed.select("day", "target").distinct(), known, min_length)
    return (
        aimed.join(verdicts, ["day", "target"], "left").withColumns(
            {"decision": _pick(0), "reason": _pick(1), "failure_class": _pick(2), "drift": _pick(3)}
        )
    )


def legacy_citations(citations: DataFrame, known: DataFrame) -> DataFrame:
    """The older boolean matcher, faults kept: any shared prefix passes once the base is over 20 long."""
    aimed = citations.withColumn("legacy_target", legacy_normalise(F.col("url")))
    base = path_only(F.col("legacy_target"))
    keys = F.array_distinct(F.array(F.col("legacy_target"), base))
    settled = (
        aimed.select("day", "legacy_target")
        .distinct()
        .select("day", "legacy_target", base.alias("base"), F.explode(keys).alias("key"))
        .join(known.select("day", F.col("canonical").alias("key"), F.lit(True).alias("hit")), ["day", "key"], "left")
        .groupBy("day", "legacy_target", "base")
        .agg(F.coalesce(F.max("hit"), F.lit(False)).alias("hit"))
        .withColumn("open", ~F.col("hit") & (F.length("base") > MIN_PREFIX_LENGTH))
    )
    settled = materialise(settled, "settled")
    bases = settled.filter("open").select("day", "base").distinct()
    near = nearest(bases, "base", known.filter("canonical <> ''")).select("day", "base", F.lit(True).alias("near"))
    passed = F.col("hit") | F.coalesce(F.col("near") & F.col("open"), F.lit(False))
    verdicts = settled.join(near, ["day", "base"], "left").groupBy("day", "legacy_target").agg(F.max(passed).alias("passed")).select(
        "day", "legacy_target", F.when(F.col("passed"), F.lit("pass")).otherwise(F.lit("fail")).alias("decision")
    )
    return aimed.join(verdicts, ["day", "legacy_target"], "left").drop("legacy_target")


def stale_days(failed: DataFrame, known: DataFrame, look_back: int | None = 30) -> DataFrame:
    """Other days whose capture holds a failed target: (day, target, other_days sorted).

    Only failed targets are looked up. With `look_back`, only the newest captured days count, the target's own day
    left out. These are at most look_back + 1 values, which go into the plan as a filter on the day: of captures
    stored by day only their partitions are read.
    """
    targets = failed.select("day", "target").distinct()
    captures = known.withColumnRenamed("day", "other_day")
    newest: list = []
    if look_back is not None:
        days = known.select("day").filter("day is not null").distinct().orderBy(F.desc("day")).limit(look_back + 1)
        newest = [r["day"] for r in days.collect()]
        captures = captures.filter(F.col("other_day").isin(newest))
    hits = targets.join(captures, targets.target == captures.canonical).filter("day <> other_day")
    if look_back is not None and len(newest) > look_back:
        # look_back days other than this one: the oldest of look_back + 1 counts only where this day is among the newest.
        hits = hits.filter((F.col("other_day") != F.lit(newest[-1])) | F.col("day").isin(newest))
    # The days of one URL are bounded by look_back; without it they are bounded by history.
    return hits.groupBy("day", "target").agg(F.sort_array(F.collect_set("other_day")).alias("other_days"))


def verify_days(classified: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Gate per day: counts, ratio and decision. A day without citations fails as malformed."""
    counts = classified.groupBy("day").agg(
        F.count(F.lit(1)).alias("cited"),
        F.count_if(F.col("decision") == "pass").alias("traced"),
        F.count_if(F.col("decision") == "cannot_verify").alias("cannot_verify"),
        F.count_if(F.col("decision") == "fail").alias("failed"),
    )
    if days is not None:
        counts = days.join(counts, "day", "left").fillna(0, ["cited", "traced", "cannot_verify", "failed"])
    decision = (
        F.when(F.col("cited") == 0, F.lit("fail"))
        .when(F.col("failed") > 0, F.lit("fail"))
        .when(F.col("cannot_verify") > 0, F.lit("cannot_verify"))
        .otherwise(F.lit("pass"))
    )
    failure = (
        F.when(F.col("cited") == 0, F.lit("malformed"))
        .when(F.col("failed") > 0, F.lit("fabricated_source"))
        .when(F.col("cannot_verify") > 0, F.lit("unknown_variant"))
    )
    ratio = F.when(F.col("cited") == 0, F.lit(1.0)).otherwise(
        F.bround(F.col("traced") / F.col("cited"), 4)
    )
    return (
        counts.withColumn("verifiable_ratio", ratio)
        .withColumn("decision", decision)
        .withColumn("failure_class", failure)
    )
