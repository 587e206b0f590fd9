"""Refund decisions: every precondition is checked against ground truth, and unknown is a deny."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.decisions import fold_columns
from attesta.functions.vocabulary import REFUND_CHECKS


def _lists(decision: str) -> Column:
    """Names of the checks with one decision, in check order."""
    return F.array_compact(
        F.array(*[F.when(F.col(check) == decision, F.lit(check)) for check in REFUND_CHECKS])
    )


def decide(
    orders: DataFrame, ledger: DataFrame, statuses: list[str], window_days: int, currency: str
) -> DataFrame:
    """orders(order_id, status, days_since_delivery, payment_ref, currency, ...) with its verdict.

    ledger(payment_ref) need not be distinct. Rows keep every input column.
    """
    paid = ledger.select("payment_ref").distinct().withColumn("_paid", F.lit(True))
    days = F.col("days_since_delivery")
    checked = (
        orders.join(paid, "payment_ref", "left")
        .withColumn(
            "order_status",
            F.when(F.col("status").isNull(), F.lit("cannot_verify"))
            .when(F.col("status").isin(*statuses), F.lit("pass"))
            .otherwise(F.lit("fail")),
        )
        .withColumn(
            "refund_window",
            F.when(days.isNull(), F.lit("cannot_verify"))
            .when(days <= window_days, F.lit("pass"))
            .otherwise(F.lit("fail")),
        )
        .withColumn("payment_reference", F.when(F.col("_paid"), F.lit("pass")).otherwise(F.lit("cannot_verify")))
        .withColumn("_cur", F.when(F.col("currency") == currency, F.lit("pass")).otherwise(F.lit("cannot_verify")))
        .withColumnRenamed("currency", "order_currency")
        .withColumnRenamed("_cur", "currency")
        .drop("_paid")
    )
    return (
        checked.withColumn("decision", fold_columns(*[F.col(c) for c in REFUND_CHECKS]))
        .withColumn("action", F.when(F.col("decision") == "pass", F.lit("approve")).otherwise(F.lit("deny")))
        .withColumn(
            "failure_class",
            F.when(F.col("decision") == "fail", F.lit("policy_violation")).when(
                F.col("decision") == "cannot_verify", F.lit("precondition_unknown")
            ),
        )
        .withColumn("failed_checks", _lists("fail"))
        .withColumn("unverified_checks", _lists("cannot_verify"))
    )


def overrides(decided: DataFrame, proposals: DataFrame) -> DataFrame:
    """Decisions with what was proposed and whether the verifier overrode it."""
    return decided.join(proposals.select("order_id", "proposed_action", "proposed_reason"), "order_id", "left").withColumn(
        "overridden", F.coalesce(F.col("proposed_action") != F.col("action"), F.lit(False))
    )


def orphan_proposals(decided: DataFrame, proposals: DataFrame) -> DataFrame:
    """Proposals for orders that do not exist."""
    return proposals.join(decided.select("order_id"), "order_id", "left_anti")


def reconcile(artifact: DataFrame, truth: DataFrame, source: str = "ground truth") -> DataFrame:
    """One row per difference between claimed and recomputed decisions, missing rows included."""
    a = artifact.select("order_id", F.col("decision").alias("claimed"), F.col("action").alias("claimed_action"), F.lit(True).alias("_a"))
    t = truth.select("order_id", F.col("decision").alias("expected"), F.col("action").alias("expected_action"), F.lit(True).alias("_t"))
    joined = a.join(t, "order_id", "full_outer")
    found = F.array_compact(
        F.array(
            F.when(F.col("_t").isNull(), F.lit("unknown_order")),
            F.when(F.col("_a").isNull(), F.lit("missing_decision")),
            F.when(F.col("_a") & F.col("_t") & ~F.col("claimed").eqNullSafe(F.col("expected")), F.lit("decision_mismatch")),
            F.when(F.col("_a") & F.col("_t") & ~F.col("claimed_action").eqNullSafe(F.col("expected_action")), F.lit("action_mismatch")),
        )
    )
    return joined.select("order_id", F.explode(found).alias("violation"), F.lit(source).alias("source"),
                         "claimed", "expected", "claimed_action", "expected_action")


def artifact_violations(artifact: DataFrame) -> DataFrame:
    """Self-consistency of claimed decisions: vocabulary, checks, lists and fail-closed actions.

    artifact(order_id, decision, action, checks array<struct<check,decision>>, failed_checks,
    unverified_checks). A row with a broken vocabulary or no checks is reported once, as that.
    """
    known = ["pass", "fail", "cannot_verify"]
    names = F.transform("checks", lambda c: c["check"])
    required = F.array(*[F.lit(c) for c in REFUND_CHECKS])
    usable = F.filter("checks", lambda c: F.array_contains(required, c["check"]) & c["decision"].isin(*known))
    prepared = artifact.withColumn("usable", usable).withColumn("names", names)

    def having(decision: str) -> Column:
        return F.array_sort(F.array_distinct(F.transform(F.filter("usable", lambda c: c["decision"] == decision), lambda c: c["check"])))

    computed = (
        F.when(F.exists("usable", lambda c: c["decision"] == "fail"), F.lit("fail"))
        .when(F.exists("usable", lambda c: c["decision"] == "cannot_verify"), F.lit("cannot_verify"))
        .otherwise(F.lit("pass"))
    )
    missing = F.array_except(required, F.transform("usable", lambda c: c["check"]))
    none = F.array().cast("array<string>")
    listed = lambda column: F.array_sort(F.coalesce(F.col(column), none))
    duplicated = F.size("names") != F.size(F.array_distinct("names"))
    unknown_check = F.exists("checks", lambda c: ~F.array_contains(required, c["check"]))
    unknown_verdict = F.exists("checks", lambda c: F.array_contains(required, c["check"]) & ~c["decision"].isin(*known))
    no_checks = F.col("checks").isNull() | (F.size("checks") == 0)
    complete = ~no_checks & (F.size(missing) == 0)
    vocabulary = F.when(~F.col("decision").isin(*known) | F.col("decision").isNull(), F.lit("unknown_decision")).when(
        ~F.col("action").isin("approve", "deny", "escalate") | F.col("action").isNull(), F.lit("unknown_action")
    )
    rules = F.array_compact(
        F.array(
            F.when(no_checks, F.lit("missing_checks")),
            F.when(~no_checks & unknown_check, F.lit("unknown_check")),
            F.when(~no_checks & unknown_verdict, F.lit("unknown_check_decision")),
            F.when(~no_checks & duplicated, F.lit("duplicate_checks")),
            F.when(~no_checks & (F.size(missing) > 0), F.lit("missing_checks")),
            F.when(complete & (F.col("decision") != computed), F.lit("contradicts_checks")),
            F.when(complete & (listed("failed_checks") != having("fail")), F.lit("failed_checks_mismatch")),
            F.when(complete & (listed("unverified_checks") != having("cannot_verify")), F.lit("unverified_checks_mismatch")),
            F.when(complete & (F.col("decision") == "pass") & (F.col("action") != "approve"), F.lit("pass_not_approved")),
            F.when(complete & (F.col("decision") == "fail") & (F.col("action") != "deny"), F.lit("fail_not_denied")),
            F.when(complete & (F.col("decision") == "cannot_verify") & (F.col("action") == "approve"), F.lit("fail_closed_violated")),
        )
    )
    found = F.when(vocabulary.isNotNull(), F.array(vocabulary)).otherwise(rules)
    return prepared.select("order_id", F.explode(found).alias("violation"))
