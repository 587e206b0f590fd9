"""Run ledger analytics over append-only tables.

Updates are appended as newer rows and folded on read, because plain Parquet has no in-place
update. Costs that are unknown stay NULL all the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.ranking import earliest_by, latest_by

DONE = ("success", "degraded")
LOST = ("failed", "crashed")


def fold_events(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Current row per key of an append-only table: the latest one."""
    return latest_by(events, keys, order, [c for c in events.columns if c not in keys])


def totals(runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts and sums; sums over no known value stay NULL."""
    return runs.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("status").isin(*DONE)).alias("ok"),
        F.count_if(F.col("status").isin(*LOST)).alias("failed"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.sum("duration_ms").alias("duration_ms"),
        F.sum(F.col("human_intervention").cast("long")).alias("interventions"),
    )


def monthly_cost(runs: DataFrame) -> DataFrame:
    """Known spend per calendar month, dry runs left out; a month without known cost is 0."""
    real = runs.filter(~F.col("dry_run"))
    return real.groupBy(F.date_trunc("month", "started_at").alias("month")).agg(
        F.coalesce(F.sum(F.when(F.col("cost_usd").isNotNull(), F.col("cost_usd"))), F.lit(0.0)).alias("spent"),
        F.count_if(F.col("cost_usd").isNull()).alias("unknown_cost_runs"),
    )


def budget_left(runs: DataFrame, now: Column, limit: float) -> DataFrame:
    """Spend of the month of `now` against a ceiling, with the filter pushed to the scan."""
    month = runs.filter(
        ~F.col("dry_run") & F.col("cost_usd").isNotNull() & (F.col("started_at") >= F.date_trunc("month", now))
    )
    return month.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spent")).withColumn(
        "blocked", F.col("spent") >= F.lit(limit)
    )


def find_done(runs: DataFrame) -> DataFrame:
    """The finished run that stands for each (task, target_date): the one that ended last."""
    done = runs.filter(F.col("status").isin(*DONE) & ~F.col("dry_run"))
    return latest_by(done, ["task", "target_date"], ["finished_at", "run_id"], ["run_id", "status", "finished_at"])


def list_runs(runs: DataFrame, limit: int = 20, task: str | None = None, experiment: str | None = None,
              experiment_prefix: str | None = None) -> DataFrame:
    """The newest runs; the filters reach the scan and the limit is a top-k, not a full sort."""
    if task:
        runs = runs.filter(F.col("task") == task)
    if experiment:
        runs = runs.filter(F.col("experiment") == experiment)
    if experiment_prefix:
        runs = runs.filter(F.col("experiment").startswith(experiment_prefix))
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)


def accept_once(candidates: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """New finished runs that may be written: the first per (task, target_date), none already done."""
    real = candidates.filter(F.col("status").isin(*DONE) & ~F.col("dry_run"))
    first = earliest_by(real, ["task", "target_date"], ["started_at", "run_id"], ["run_id", "status", "started_at"])
    return first if done is None else first.join(done.select("task", "target_date").distinct(), ["task", "target_date"], "left_anti")


def duplicate_done(runs: DataFrame) -> DataFrame:
    """Violations of 'one finished real run per task and date', for the check after a write."""
    done = runs.filter(F.col("status").isin(*DONE) & ~F.col("dry_run"))
    return done.groupBy("task", "target_date").agg(F.count(F.lit(1)).alias("runs")).filter("runs > 1")


def mark_stale(runs: DataFrame, live: DataFrame) -> DataFrame:
    """Running runs whose process is gone, as the crashed rows to append."""
    running = runs.filter("status = 'running'")
    return (
        running.join(live.select("pid").distinct(), "pid", "left_anti")
        .withColumn("status", F.lit("crashed"))
        .withColumn("failure_class", F.lit("stale_process"))
    )


def supersede(runs: DataFrame, retired: DataFrame) -> DataFrame:
    """Rows to append for retired(run_id, reason): status superseded, reason added to the notes."""
    note = F.concat(F.lit("superseded: "), F.col("reason"))
    return (
        runs.join(retired.select("run_id", "reason"), "run_id")
        .withColumn("status", F.lit("superseded"))
        .withColumn("notes", F.concat_ws("\n", "notes", note))
        .drop("reason")
    )


def annotations(notes: DataFrame) -> DataFrame:
    """notes(run_id, seq, note, intervened): all notes of a run in order and its last flag.

    The notes of one run are written by hand, which bounds the list.
    """
    ordered = F.sort_array(F.collect_list(F.when(F.col("note").isNotNull(), F.struct("seq", "note"))))
    return notes.groupBy("run_id").agg(
        F.array_join(F.transform(ordered, lambda n: n["note"]), "\n").alias("notes"),
        F.max_by("intervened", F.when(F.col("intervened").isNotNull(), F.col("seq"))).alias("intervened"),
    )


def tool_call_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy("run_id").agg(F.count(F.lit(1)).alias("tool_calls"))


def merge_metrics(metrics: DataFrame) -> DataFrame:
    """metrics(run_id, seq, name, value): tokens and cost add up, any other name keeps its last value."""
    adds = F.col("name").isin("tokens_in", "tokens_out", "cost_usd")
    return metrics.groupBy("run_id", "name").agg(
        F.when(F.first(adds), F.sum("value")).otherwise(F.max_by("value", "seq")).alias("value")
    )


def usage(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, tokens, cost and abstentions; cost is NULL when no call has a known one."""
    return calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.sum("cost_usd").alias("cost_usd"),
        F.count_if(F.col("probability").isNull()).alias("abstentions"),
    )


def run_status(steps: DataFrame, validations: DataFrame) -> DataFrame:
    """failed > degraded > success over the steps of a run and its required validations."""
    level = F.when(F.col("status") == "failed", 2).when(F.col("degraded"), 1).otherwise(0)
    by_step = steps.groupBy("run_id").agg(F.max(level).alias("step_level"))
    by_gate = validations.groupBy("run_id").agg(F.max(F.when(F.col("required") & ~F.col("ok"), 2).otherwise(0)).alias("gate_level"))
    worst = F.greatest(F.coalesce("step_level", F.lit(0)), F.coalesce("gate_level", F.lit(0)))
    return by_step.join(by_gate, "run_id", "full_outer").select(
        "run_id", F.when(worst == 2, "failed").when(worst == 1, "degraded").otherwise("success").alias("status")
    )


def integrity(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Rows, and keys held by more than one row, per named (table, key columns)."""
    parts = []
    for name, (df, keys) in tables.items():
        per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        parts.append(per_key.agg(
            F.lit(name).alias("table"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.count_if(F.col("n") > 1).alias("duplicate_keys"),
        ))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("table", "rows", "duplicate_keys")
