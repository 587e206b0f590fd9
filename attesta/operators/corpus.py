"""Labelled corpora for measuring matchers: seven kinds of citation with a known right answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.functions.urls import (
    attack_extension,
    attack_suffix,
    attack_unrelated,
    canonical_url,
    path_only,
    rotated_drift,
)
from attesta.functions.vocabulary import EXPECT_NOT_PASS, EXPECT_PASS, MIN_PREFIX_LENGTH
from attesta.operators.ranking import row_numbers, top_k
from attesta.session import materialise


def _samples(df: DataFrame, stem: str, kind: str, expect: str) -> DataFrame:
    number = F.format_string("%03d", F.col("index"))
    return df.select(
        F.concat_ws("-", F.col("day").cast("string"), F.lit(stem), number).alias("sample_id"),
        F.lit(kind).alias("kind"), "url", "day", F.lit(expect).alias("expect"),
    )


def _stale(cites: DataFrame, known: DataFrame, cap: int) -> DataFrame:
    """The first `cap` URLs cited on other days and foreign to this day, per day.

    The pool of a day is almost the whole list of cited URLs, so it is never built. All first
    citations are numbered once (list L). For a day only its exclusions are joined in: entries
    of L that the day captured, by URL or by path, or cited first itself. If e_k is the place of
    its k-th exclusion, the j-th URL left is at place j + #{k : e_k - k < j}, so `cap` places
    per day follow from counts. A URL the day cited first but others cited later re-enters
    with its first citation elsewhere.
    """
    per_day = cites.groupBy("canonical", "day").agg(
        F.min("position").alias("position"), F.min_by("url", "position").alias("url")
    )
    per_day = materialise(per_day, "per_day")
    first = per_day.groupBy("canonical").agg(F.min(F.struct("position", "day", "url")).alias("f")).select("canonical", "f.*")
    listed = materialise(row_numbers(first, [], "position", "place"), "listed")
    paths = known.select("day", path_only(F.col("canonical")).alias("path")).distinct()
    by_path = (
        listed.select("canonical", path_only(F.col("canonical")).alias("path"), "place")
        .join(paths, "path")
        .select("day", "place")
    )
    own = listed.select("day", "place")
    excluded = by_path.unionByName(own).distinct()
    ordered = row_numbers(excluded, ["day"], "place", "k")
    steps = (
        ordered.withColumn("shift", F.col("place") - F.col("k"))
        .filter(F.col("shift") < cap)
        .groupBy("day", "shift")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    days = known.select("day").distinct()
    slots = days.select("day", F.explode(F.sequence(F.lit(1), F.lit(cap))).alias("j"))
    wanted = (
        slots.join(steps, "day", "left")
        .groupBy("day", "j")
        .agg(F.coalesce(F.sum(F.when(F.col("shift") < F.col("j"), F.col("n"))), F.lit(0)).alias("gone"))
        .select("day", (F.col("j") + F.col("gone")).alias("place"))
    )
    main = wanted.join(listed.select("place", "position", "url", "canonical"), "place").select("day", "position", "url", "canonical")
    # Cited here first, cited elsewhere later, and not captured here under any query.
    elsewhere = per_day.alias("o").join(
        first.select("canonical", F.col("day").alias("own_day")), "canonical"
    ).filter(F.col("o.day") != F.col("own_day"))
    again = elsewhere.groupBy("canonical", "own_day").agg(
        F.min("o.position").alias("position"), F.min_by("o.url", "o.position").alias("url")
    )
    missing_here = (
        again.withColumn("path", path_only(F.col("canonical")))
        .withColumnRenamed("own_day", "day")
        .join(paths, ["day", "path"], "left_anti")
        .select("day", "position", "url", "canonical")
    )
    return top_k(main.unionByName(missing_here), cap, ["day"], [F.col("position")], "n").withColumn(
        "index", F.col("n") - 1
    )


def build_corpus(cited: DataFrame, known: DataFrame, cap: int = 25) -> DataFrame:
    """cited(day, position, url) and known(day, canonical) as labelled samples.

    `position` orders all citations over days. Caps per kind and day are top-k windows, which
    cut each day in the map tasks.
    """
    ids = materialise(cited.select("day", "position", "url", canonical_url(F.col("url")).alias("canonical")), "cited")
    known = materialise(known, "known")
    in_capture = known.select("day", "canonical")
    legit = top_k(ids.join(in_capture, ["day", "canonical"], "left_semi"), cap, ["day"], [F.col("position")], "n")
    legit = legit.withColumn("index", F.col("n") - 1)
    drift = legit.withColumn("d", rotated_drift(F.col("url"), F.col("index"))).filter("d is not null")
    bases = top_k(
        known.filter(F.length("canonical") > MIN_PREFIX_LENGTH), cap, ["day"], [F.col("canonical")], "n"
    ).withColumn("index", F.col("n") - 1)

    def attack(builder) -> DataFrame:
        built = bases.withColumn("url", builder(F.col("canonical")))
        target = built.withColumn("target", canonical_url(F.col("url")))
        return target.join(
            in_capture.withColumnRenamed("canonical", "target"), ["day", "target"], "left_anti"
        )

    days = known.select("day").distinct()
    unrelated = days.select("day", F.explode(F.sequence(F.lit(0), F.lit(min(5, cap) - 1))).alias("index"))
    unrelated = unrelated.withColumn("url", attack_unrelated(F.col("day"), F.col("index")))
    uncited = top_k(
        known.join(ids.select("day", "canonical"), ["day", "canonical"], "left_anti"), cap, ["day"], [F.col("canonical")], "n"
    ).select("day", (F.col("n") - 1).alias("index"), F.concat(F.lit("https://"), "canonical").alias("url"))
    parts = [
        _samples(legit, "legit", "legit", EXPECT_PASS),
        _samples(drift.withColumn("url", F.col("d.url")), "drift", "legit_drift", EXPECT_PASS),
        _samples(attack(attack_extension), "ext", "prefix_extension", EXPECT_NOT_PASS),
        _samples(attack(attack_suffix), "fab", "fabricated_suffix", EXPECT_NOT_PASS),
        _samples(unrelated, "unrel", "unrelated", EXPECT_NOT_PASS),
        _samples(_stale(ids, known, cap), "stale", "stale_evidence", EXPECT_NOT_PASS),
        _samples(uncited, "uncited", "plausible_uncited", EXPECT_PASS),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def subsample(samples: DataFrame, per_kind: int) -> DataFrame:
    """The first samples of each kind, by day and id: every matcher must see the same ones."""
    if per_kind <= 0:
        return samples
    return top_k(samples, per_kind, ["kind"], [F.col("day"), F.col("sample_id")], "n").drop("n")
