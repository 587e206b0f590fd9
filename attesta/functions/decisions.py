"""The four-valued decision algebra. NULL never becomes 'pass'."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.vocabulary import DECISIONS, FAILURE_CLASSES, POLICY_ACTIONS


def severity(decision: Column) -> Column:
    """0 pass < 1 abstain < 2 cannot_verify < 3 fail; an unknown or NULL word counts as 2."""
    ranked = F.lit(DECISIONS.index("cannot_verify"))
    for rank, word in enumerate(DECISIONS):
        ranked = F.when(decision == word, F.lit(rank)).otherwise(ranked)
    return ranked


def decision_of(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(word) for word in DECISIONS]), rank + 1)


def fold(decisions: Column) -> Column:
    """Aggregate: the worst decision of a group. An empty group is a pass only by its caller."""
    return decision_of(F.max(severity(decisions)))


def fold_columns(*decisions: Column) -> Column:
    """Row-wise fold of several decision columns."""
    return decision_of(F.greatest(*[severity(decision) for decision in decisions]))


def check_policy(policy: Mapping[str, str] | None) -> dict[str, str]:
    """Validated on_fail / on_cannot_verify / on_abstain; everything blocks by default."""
    full = {"on_fail": "block", "on_cannot_verify": "block", "on_abstain": "block"}
    full.update(policy or {})
    for key, value in full.items():
        if value not in POLICY_ACTIONS:
            raise ValueError(f"policy.{key}={value!r} is not one of {POLICY_ACTIONS}")
    return full


def policy_action(decision: Column, policy: Mapping[str, str] | None = None) -> Column:
    rules = check_policy(policy)
    return (
        F.when(decision == "pass", F.lit("allow"))
        .when(decision == "fail", F.lit(rules["on_fail"]))
        .when(decision == "abstain", F.lit(rules["on_abstain"]))
        .otherwise(F.lit(rules["on_cannot_verify"]))
    )


def allowed(decision: Column, action: Column) -> Column:
    return F.coalesce((decision == "pass") | (action == "warn"), F.lit(False))


def is_known_failure_class(column: Column) -> Column:
    return column.isNull() | column.isin(*FAILURE_CLASSES)


def verdict_for(probability: Column, threshold: Column, band: float = 0.0) -> Column:
    """One probability against one threshold; inside the band, and for NULL, undecided."""
    verdict = F.when(probability.isNull(), F.lit("cannot_verify"))
    if band > 0:
        verdict = verdict.when(F.abs(probability - threshold) < band / 2.0, F.lit("cannot_verify"))
    return verdict.when(probability >= threshold, F.lit("pass")).otherwise(F.lit("fail"))


def rule_probability(decision: Column) -> Column:
    """A rule verdict on the judge's scale: pass 1, fail 0, anything undecided NULL."""
    return F.when(decision == "pass", F.lit(1.0)).when(decision == "fail", F.lit(0.0))


def rate(hits: Column, total: Column, digits: int = 4) -> Column:
    """hits / total rounded half to even, NULL for an empty denominator."""
    return F.bround(F.try_divide(hits.cast("double"), total.cast("double")), digits)
