"""Experiments: which arms are not beaten on cost and verification at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.session import materialise


def verification_score() -> Column:
    """Share of the acceptance gate an arm satisfied; NULL when it never reached validation."""
    return F.coalesce(
        F.col("verifiable_ratio"),
        F.when(F.col("validators_ok"), F.lit(1.0)).when(~F.col("validators_ok"), F.lit(0.0)),
    )


def arm_points(runs: DataFrame) -> DataFrame:
    """One averaged point per arm. The axis is USD if any run has a price, else tokens."""
    axis = runs.agg(F.coalesce(F.max(F.col("cost_usd").isNotNull()), F.lit(False)).alias("use_usd"))
    tokens = F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0))
    cost = F.when(F.col("use_usd"), F.col("cost_usd")).otherwise(tokens.cast("double"))
    scored = (
        runs.crossJoin(F.broadcast(axis))
        .withColumn("cost", cost)
        .withColumn("score", verification_score())
        .filter("cost is not null and score is not null")
    )
    return scored.groupBy("arm").agg(
        F.count(F.lit(1)).alias("runs"),
        F.bround(F.avg("cost"), 6).alias("cost"),
        F.bround(F.avg("score"), 6).alias("score"),
        F.min_by("status", F.struct("started_at", "run_id")).alias("status"),
        F.min_by("compose_mode", F.struct("started_at", "run_id")).alias("compose_mode"),
        F.when(F.first("use_usd"), F.lit("cost_usd")).otherwise(F.lit("tokens")).alias("axis"),
    )


def pareto(points: DataFrame) -> DataFrame:
    """Points with `pareto_optimal`: the best score at their cost, and better than any cheaper one. Equal points are both kept.

    Costs are cut once into ranges, as many as their number asks for. A range is compared within itself
    and with the best score of the ranges before it, so no window spans all arms.
    """
    at_cost = points.groupBy("cost").agg(F.max("score").alias("best"))
    ranged = materialise(at_cost.repartitionByRange("cost").withColumn("_slice", F.spark_partition_id()), "ranges")
    earlier = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranged.groupBy("_slice").agg(F.max("best").alias("top")).select("_slice", F.max("top").over(earlier).alias("_offset"))
    cheaper = W.partitionBy("_slice").orderBy("cost").rowsBetween(W.unboundedPreceding, -1)
    steps = ranged.join(offsets, "_slice").withColumn("before", F.greatest(F.max("best").over(cheaper), "_offset"))
    front = steps.filter("before is null or best > before").select("cost", F.col("best").alias("score"), F.lit(True).alias("pareto_optimal"))
    return points.join(front, ["cost", "score"], "left").withColumn("pareto_optimal", F.coalesce("pareto_optimal", F.lit(False)))


def frontier(points: DataFrame) -> DataFrame:
    """The optimal points of pareto(), from the cheapest on; equal points by arm."""
    return points.filter("pareto_optimal").orderBy("cost", F.desc("score"), "arm")


def caveats(runs: DataFrame, points: DataFrame) -> DataFrame:
    """What a reader of the frontier must know (one row of counts)."""
    unscored = runs.agg(F.count_if(verification_score().isNull()).alias("unscored_runs"))
    replay = points.agg(
        F.count_if(F.col("pareto_optimal") & (F.col("compose_mode") == "replay")).alias("replay_on_frontier"),
        F.max((F.col("axis") == "tokens").cast("int")).alias("tokens_axis"),
    )
    return unscored.crossJoin(replay)


def blocked_reason(requires: Column, executor: Column, allow_llm: bool, allow_network: bool, dry_run: bool) -> Column:
    """Why an arm may not run; NULL when it may. `requires` is array<string>."""
    paid = F.array_contains(requires, "llm") | F.array_contains(requires, "executor")
    delegated = F.array_contains(requires, "executor")
    return (
        F.when(paid & F.lit(not allow_llm), F.lit("needs_llm"))
        .when(F.array_contains(requires, "network") & F.lit(not allow_network), F.lit("needs_network"))
        .when(delegated & (F.coalesce(executor, F.lit("")) == ""), F.lit("no_executor"))
        .when(delegated & F.lit(dry_run), F.lit("dry_run"))
    )


def arm_runs(runs: DataFrame, validations: DataFrame, prefix: str, limit: int | None = None) -> DataFrame:
    """Experiment runs rebuilt from the ledger: all runs of a prefix, or its newest `limit`, with their gate results.

    validations(run_id, name, ok, required, verifiable_ratio). Advisory gates do not count.
    """
    chosen = runs.filter(F.col("experiment").startswith(prefix))
    if limit is not None:
        chosen = chosen.orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)
    gates = validations.groupBy("run_id").agg(
        F.min(F.when(F.col("required"), F.col("ok"))).alias("validators_ok"),
        F.max(F.when(F.col("name") == "verifiable", F.col("verifiable_ratio"))).alias("verifiable_ratio"),
    )
    return chosen.join(gates, "run_id", "left")
