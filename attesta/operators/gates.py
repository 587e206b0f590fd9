"""The gate registry, its runner, and what is made of many gate results.

A gate takes named DataFrames and returns one row per checked entity with at least
(entity, decision). The runner lines them up as
(gate, entity, decision, failure_class, policy_action, ok).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.decisions import allowed, decision_of, policy_action, severity
from attesta.functions.vocabulary import DECISIONS
from attesta.operators import contract, coverage, dedup, merge_review, provenance, refund
from attesta.session import materialise
from attesta.sources import pages
from attesta.sources.capture import capture_urls, signal_rows

Inputs = Mapping[str, DataFrame]
Gate = Callable[..., DataFrame]
GATES: dict[str, Gate] = {}


def gate(name: str) -> Callable[[Gate], Gate]:
    def register(function: Gate) -> Gate:
        GATES[name] = function
        return function

    return register


def get(name: str) -> Gate:
    if name not in GATES:
        raise KeyError(f"unknown gate {name!r}; known: {sorted(GATES)}")
    return GATES[name]


@gate("json_parseable")
def _json(inputs: Inputs) -> DataFrame:
    return contract.json_gate(inputs["files"]).withColumnRenamed("path", "entity")


@gate("files_exist")
def _files(inputs: Inputs) -> DataFrame:
    absent = contract.files_gate(inputs["expected"], inputs["files"]).withColumn("decision", F.lit("fail"))
    found = inputs["expected"].select("path").distinct().join(absent, "path", "left")
    return found.select(F.col("path").alias("entity"), F.coalesce("decision", F.lit("pass")).alias("decision"))


@gate("structure")
def _structure(inputs: Inputs) -> DataFrame:
    return contract.structure_gate(inputs["articles"]).withColumnRenamed("day", "entity")


@gate("references")
def _references(inputs: Inputs) -> DataFrame:
    return contract.references_gate(inputs["articles"]).withColumnRenamed("day", "entity")


@gate("duplicates")
def _duplicates(inputs: Inputs, borderline: str = "warn") -> DataFrame:
    """An article whose shape is undeclared cannot be checked for duplicates."""
    candidates = materialise(contract.dedup_candidates(inputs["articles"]), "candidates")
    classes, pairs = dedup.plan(candidates)
    dropped = dedup.resolve(candidates, classes, pairs)
    counts = dedup.duplicate_gate(candidates, classes, pairs, dropped, borderline)
    shape = contract.structure_gate(inputs["articles"]).select(
        "day", (F.col("failure_class") == "unknown_variant").alias("odd"), F.col("failures").isNull().alias("broken")
    )
    joined = shape.join(counts.withColumnRenamed("article", "day"), "day", "left")
    return joined.select(
        F.col("day").alias("entity"),
        F.when(F.col("broken"), F.lit("fail"))
        .when(F.coalesce("odd", F.lit(False)), F.lit("cannot_verify"))
        .otherwise(F.coalesce("decision", F.lit("pass")))
        .alias("decision"),
        F.coalesce("duplicate_pairs", F.lit(0)).alias("duplicate_pairs"),
        F.coalesce("borderline_pairs", F.lit(0)).alias("borderline_pairs"),
    )


@gate("verifiable")
def _verifiable(inputs: Inputs) -> DataFrame:
    """A day without a capture fails: nothing on it can be traced."""
    known = provenance.known_urls(capture_urls(inputs["captures"]))
    cited = contract.cited_references(inputs["articles"])
    judged = provenance.classify_citations(cited, known)
    failed = judged.filter("decision = 'fail' and target <> ''")
    stale = provenance.stale_days(failed, known).select("day", "target", F.lit(1).alias("stale"))
    per_day = judged.join(stale, ["day", "target"], "left").groupBy("day").agg(F.coalesce(F.sum("stale"), F.lit(0)).alias("stale_citations"))
    days = inputs["articles"].select("day")
    return (
        provenance.verify_days(judged, days)
        .join(per_day, "day", "left")
        .join(inputs["captures"].select("day", F.lit(True).alias("captured")), "day", "left")
        .withColumn("raw_missing", F.col("captured").isNull())
        .withColumn("decision", F.when(F.col("raw_missing"), F.lit("fail")).otherwise(F.col("decision")))
        .withColumn("stale_citations", F.coalesce("stale_citations", F.lit(0)))
        .withColumn("unknown_citations", F.col("failed") - F.col("stale_citations"))
        .drop("captured")
        .withColumnRenamed("day", "entity")
    )


@gate("depth")
def _depth(inputs: Inputs, min_ratio: float = 0.6, profile: contract.Profile | None = None) -> DataFrame:
    return contract.depth_gate(inputs["articles"], min_ratio, profile).withColumnRenamed("day", "entity")


@gate("brief")
def _brief(inputs: Inputs, limit: int = 5, profile: contract.Profile | None = None) -> DataFrame:
    return contract.brief_gate(inputs["articles"], limit, profile).withColumnRenamed("day", "entity")


@gate("coverage")
def _coverage(inputs: Inputs, k: int = 10, keywords: list[str] | None = None) -> DataFrame:
    """Advisory. A day without a capture cannot be checked."""
    pool = coverage.ranked_pool(signal_rows(inputs["captures"]), k)
    pool = pool.withColumn("on_topic", coverage.on_topic(F.concat_ws(" ", "title", "text"), keywords))
    cited = provenance.known_urls(contract.cited_references(inputs["articles"]))
    tally = coverage.coverage_gate(coverage.mark_covered(pool, cited))
    have = inputs["captures"].select("day", F.lit(True).alias("captured"))
    joined = inputs["articles"].select("day").join(have, "day", "left").join(tally, "day", "left")
    return joined.withColumn(
        "decision", F.when(F.col("captured").isNull(), F.lit("cannot_verify")).otherwise(F.lit("pass"))
    ).drop("captured").withColumnRenamed("day", "entity")


@gate("sitemap")
def _sitemap(inputs: Inputs) -> DataFrame:
    return pages.sitemap_gate(inputs["sitemaps"]).withColumnRenamed("path", "entity")


@gate("index")
def _index(inputs: Inputs, earliest: str = "2026-09-01") -> DataFrame:
    return pages.index_gate(inputs["index_pages"], earliest).withColumnRenamed("page_id", "entity")


@gate("refund_fail_closed")
def _refund(inputs: Inputs) -> DataFrame:
    """Claimed refund decisions against themselves and against the recomputed truth."""
    own = refund.artifact_violations(inputs["artifact"]).select("order_id", "violation")
    against = refund.reconcile(inputs["artifact"], inputs["truth"]).select("order_id", "violation")
    bad = own.unionByName(against).groupBy("order_id").agg(F.count(F.lit(1)).alias("violations"))
    everyone = inputs["artifact"].select("order_id").unionByName(inputs["truth"].select("order_id")).distinct()
    return everyone.join(bad, "order_id", "left").select(
        F.col("order_id").alias("entity"),
        F.coalesce("violations", F.lit(0)).alias("violations"),
        F.when(F.col("violations") > 0, F.lit("fail")).otherwise(F.lit("pass")).alias("decision"),
    )


@gate("merge")
def _merge(inputs: Inputs) -> DataFrame:
    return merge_review.merge_gate(inputs["checks"], inputs.get("reviews")).withColumnRenamed("change_id", "entity")


def _failure_class(df: DataFrame) -> Column:
    """A result that is not a pass always has a class; policy_violation when the gate gave none."""
    given = F.col("failure_class") if "failure_class" in df.columns else F.lit(None).cast("string")
    return F.when(F.col("decision") == "pass", F.lit(None).cast("string")).otherwise(F.coalesce(given, F.lit("policy_violation")))


def result_rows(name: str, df: DataFrame, policy: Mapping[str, str] | None = None) -> DataFrame:
    """A gate's rows in the common shape; an unknown decision word is an undecided one."""
    decision = F.when(F.col("decision").isin(*DECISIONS), F.col("decision")).otherwise(F.lit("cannot_verify"))
    named = df.withColumn("decision", decision)
    action = policy_action(F.col("decision"), policy)
    return named.select(
        F.lit(name).alias("gate"),
        F.col("entity").cast("string").alias("entity"),
        "decision",
        _failure_class(named).alias("failure_class"),
        action.alias("policy_action"),
        allowed(F.col("decision"), action).alias("ok"),
    )


def run_gates(
    spark: SparkSession, names: list[str], inputs: Inputs, policy: Mapping[str, str] | None = None,
    arguments: Mapping[str, dict] | None = None, expected: DataFrame | None = None,
) -> DataFrame:
    """Union of the named gates' results, each executed and written as its own job.

    A gate that cannot be planned, or whose job ends with an error after Spark's own retries, is a failed
    result and leaves the others' results as they are. With `expected` (entity), each named gate has a result
    for each of these entities: where a gate gave none, or is broken, the result is a failure.
    """
    out = None
    for name in names:
        function = get(name)
        try:
            # Writing it here is the barrier: later readers meet rows and not the gate's plan.
            rows = materialise(result_rows(name, function(inputs, **(arguments or {}).get(name, {})), policy), f"gate-{name}")
        except (PySparkException, Py4JError, KeyError) as problem:
            broken = spark.range(1).select(
                F.lit(None).cast("string").alias("entity"), F.lit("fail").alias("decision"),
                F.lit("internal_error").alias("failure_class"), F.lit(type(problem).__name__).alias("detail"),
            )
            rows = result_rows(name, broken, policy)
        out = rows if out is None else out.unionByName(rows)
    if expected is None or out is None:
        return out
    listed = F.explode(F.array(*[F.lit(name) for name in names])).alias("gate")
    every = expected.select(F.col("entity").cast("string").alias("entity")).distinct().select("entity", listed)
    gaps = every.join(out.select("gate", "entity"), ["gate", "entity"], "left_anti")
    missing = gaps.select(
        "gate", "entity", F.lit("fail").alias("decision"), F.lit("internal_error").alias("failure_class"),
        policy_action(F.lit("fail"), policy).alias("policy_action"), F.lit(False).alias("ok"),
    )
    return out.filter("entity is not null").unionByName(missing)


def combine(results: DataFrame, keys: list[str]) -> DataFrame:
    """Run-level verdict per key: worst decision, counts, and which gates block or are uncertain.

    The two lists hold gate names, which the registry bounds.
    """
    decision = F.col("decision")
    blocks = (decision == "fail") | (decision.isin("cannot_verify", "abstain") & (F.col("policy_action") == "block"))
    return results.groupBy(*keys).agg(
        decision_of(F.max(severity(decision))).alias("decision"),
        *[F.count_if(decision == word).alias(f"n_{word}") for word in DECISIONS],
        F.array_join(F.array_sort(F.collect_set(F.when(blocks, F.col("gate")))), ",").alias("blocking"),
        F.array_join(F.array_sort(F.collect_set(F.when(decision == "cannot_verify", F.col("gate")))), ",").alias("uncertain"),
    )


def repair_brief(results: DataFrame, severity_table: DataFrame | None = None) -> DataFrame:
    """Results that are not ok, as 'entry' when the gate is required and 'warning' when it is not.

    severity_table(gate, required) is the declaration, a few rows; without it all are required.
    """
    bad = results.filter(~F.col("ok"))
    if severity_table is None:
        return bad.withColumn("role", F.lit("entry"))
    declared = bad.join(severity_table.select("gate", "required"), "gate", "left")
    required = F.coalesce("required", F.lit(False))
    return declared.withColumn("role", F.when(required, F.lit("entry")).otherwise(F.lit("warning"))).drop("required")


def content_debt(results: DataFrame, required: list[str]) -> DataFrame:
    """Per day: which required gates block, whether the contract is behind the shape, and clean.

    A required gate without a result for a day blocks it. One that is broken as a whole (no entity)
    blocks every day. The lists hold gate names, which `required` bounds.
    """
    declared = F.col("gate").isin(*required)
    blocker = declared & ~F.coalesce("ok", F.lit(False))
    broken = results.filter(F.col("entity").isNull() & blocker).agg(F.collect_set("gate").alias("broken"))
    names = F.array(*[F.lit(name) for name in required]) if required else F.array().cast("array<string>")
    tally = results.filter("entity is not null").groupBy(F.col("entity").alias("day")).agg(
        F.collect_set(F.when(blocker, F.col("gate"))).alias("bad"),
        F.collect_set(F.when(declared, F.col("gate"))).alias("given"),
        F.coalesce(F.max((F.col("gate") == "structure") & (F.col("decision") == "cannot_verify")), F.lit(False)).alias("gate_stale"),
    )
    blockers = F.array_sort(F.array_distinct(F.concat("bad", "broken", F.array_except(names, F.col("given")))))
    return tally.crossJoin(F.broadcast(broken)).select(
        "day", F.array_join(blockers, ",").alias("blockers"), "gate_stale", (F.size(blockers) == 0).alias("clean")
    )


def release_gate(debt: DataFrame, verifiable: DataFrame, days: int = 1) -> DataFrame:
    """May the newest days be published?

    Any required gate other than 'verifiable' blocks. 'verifiable' blocks only without a capture
    or when some citation is in no capture at all; citations from another day only warn.
    """
    if days < 1:
        raise ValueError("days must be at least 1")
    newest = debt.orderBy(F.desc("day")).limit(days)
    facts = verifiable.select(F.col("entity").alias("day"), "raw_missing", "unknown_citations", "stale_citations")
    joined = newest.join(facts, "day", "left")
    names = F.filter(F.split("blockers", ","), lambda n: n != "")
    hard = F.filter(names, lambda n: n != "verifiable")
    unverifiable = F.array_contains(names, "verifiable")
    untraceable = F.coalesce("raw_missing", F.lit(True)) | (F.coalesce("unknown_citations", F.lit(0)) > 0)
    blocking = F.when(unverifiable & untraceable, F.concat(hard, F.array(F.lit("verifiable")))).otherwise(hard)
    return joined.select(
        "day",
        F.array_join(blocking, ",").alias("hard_blockers"),
        (unverifiable & ~untraceable).alias("warned"),
        F.when(F.size(blocking) > 0, F.lit("block")).otherwise(F.lit("publish")).alias("release"),
    )
