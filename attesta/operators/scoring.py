"""Measuring gates: confusion matrices, sweeps, AUC, recommendations, baselines.

Every measure first folds samples into counts per (expectation, kind, probability). Thresholds
are applied to those counts, so a sweep costs one pass over the samples however many points it
has, and no sample is repeated per threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.functions.decisions import rate, verdict_for
from attesta.functions.vocabulary import EXPECT_NOT_PASS, EXPECT_PASS


def _n(condition: Column, weight: str | None = None) -> Column:
    if weight is None:
        return F.count_if(condition)
    return F.sum(F.when(condition, F.col(weight)).otherwise(F.lit(0)))


def confusion(scored: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Rates per key over (expect, verdict) rows, or over pre-counted rows with a weight."""
    attack = F.col("expect") == EXPECT_NOT_PASS
    legit = ~attack
    total = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = scored.groupBy(*keys).agg(
        total.alias("samples"),
        _n(attack, weight).alias("attacks"),
        _n(legit, weight).alias("legit"),
        _n(attack & (F.col("verdict") == "pass"), weight).alias("false_pass_count"),
        _n(legit & (F.col("verdict") == "fail"), weight).alias("false_fail_count"),
        _n(F.col("verdict") == "cannot_verify", weight).alias("cannot_verify_count"),
    )
    return (
        counts.withColumn("false_pass_rate", rate(F.col("false_pass_count"), F.col("attacks")))
        .withColumn("false_fail_rate", rate(F.col("false_fail_count"), F.col("legit")))
        .withColumn("cannot_verify_rate", rate(F.col("cannot_verify_count"), F.col("samples")))
    )


def per_kind(scored: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Counts per kind and verdict, one column per verdict."""
    return scored.groupBy(*keys, "kind").agg(
        *[_n(F.col("verdict") == v, weight).alias(f"n_{v}") for v in ("pass", "fail", "cannot_verify", "abstain")]
    )


def sample_flags(scored: DataFrame) -> DataFrame:
    """safe: neither leaked nor rejected; strict: committed to the definite right verdict."""
    expects_pass = F.col("expect") == EXPECT_PASS
    passed = F.col("verdict") == "pass"
    return scored.withColumn("safe", passed == expects_pass).withColumn(
        "strict", F.when(expects_pass, passed).otherwise(F.col("verdict") == "fail")
    )


def probability_counts(samples: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """samples(expect, kind, probability) as counts `n` per distinct value."""
    return samples.groupBy("expect", "kind", "probability", *(extra or [])).agg(F.count(F.lit(1)).alias("n"))


def at_thresholds(counts: DataFrame, thresholds: list[float], band: float = 0.0) -> DataFrame:
    """Verdict counts at each threshold: (threshold, expect, kind, verdict, n)."""
    points = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    return counts.select("*", points).withColumn(
        "verdict", verdict_for(F.col("probability"), F.col("threshold"), band)
    )


def sweep(counts: DataFrame, thresholds: list[float], band: float = 0.0) -> DataFrame:
    """The curve: one confusion row per threshold."""
    return confusion(at_thresholds(counts, thresholds, band), ["threshold"], "n")


def operating_point(curve: DataFrame, max_false_fail: float | None = None) -> DataFrame:
    """The lowest threshold without a false pass (one row, or none)."""
    clean = curve.filter(F.col("false_pass_rate") == 0.0)
    if max_false_fail is not None:
        clean = clean.filter(F.coalesce("false_fail_rate", F.lit(0.0)) <= max_false_fail)
    return clean.orderBy("threshold").limit(1)


def best_point(curve: DataFrame) -> DataFrame:
    """The threshold with the best Youden J, the lowest on ties (one row, or none)."""
    youden = (F.lit(1.0) - F.col("false_fail_rate")) - F.col("false_pass_rate")
    return (
        curve.filter("false_pass_rate is not null and false_fail_rate is not null")
        .withColumn("youden", youden)
        .orderBy(F.desc("youden"), "threshold")
        .limit(1)
    )


def auc(counts: DataFrame) -> DataFrame:
    """Rank-based separation with ties as half, abstentions left out (one row).

    Ranks come from a running sum over distinct probabilities. The sum has two levels, over
    1/1000-wide cells and inside each cell, so neither window grows with the samples.
    """
    by_value = (
        counts.filter("probability is not null")
        .groupBy("probability")
        .agg(
            _n(F.col("expect") == EXPECT_PASS, "n").alias("pos"),
            _n(F.col("expect") == EXPECT_NOT_PASS, "n").alias("neg"),
        )
        .withColumn("cell", F.floor(F.col("probability") * 1000))
    )
    earlier = W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = (
        by_value.groupBy("cell")
        .agg(F.sum("neg").alias("cell_neg"))
        .select("cell", F.coalesce(F.sum("cell_neg").over(earlier), F.lit(0)).alias("before"))
    )
    inside = W.partitionBy("cell").orderBy("probability").rowsBetween(W.unboundedPreceding, -1)
    ranked = by_value.withColumn("within", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(cells, "cell")
    # Twice the number of wins, an integer: 2 * attacks below + 1 * attacks tied.
    doubled = F.sum(
        (F.col("pos") * (F.lit(2) * (F.col("before") + F.col("within")) + F.col("neg"))).cast("decimal(38,0)")
    )
    total = ranked.agg(
        doubled.alias("doubled"),
        F.coalesce(F.sum("pos"), F.lit(0)).alias("legit_decided"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("attack_decided"),
    )
    pairs = F.col("legit_decided").cast("double") * F.col("attack_decided").cast("double") * 2
    return total.select(
        F.when(pairs > 0, F.bround(F.col("doubled").cast("double") / pairs, 4)).alias("auc"),
        "legit_decided",
        "attack_decided",
    )


def degeneracy(counts: DataFrame) -> DataFrame:
    """How many decided probabilities are exactly 0 or 1 (one row)."""
    decided = F.col("probability").isNotNull()
    extreme = decided & F.col("probability").isin(0.0, 1.0)
    return counts.agg(
        F.coalesce(_n(decided, "n"), F.lit(0)).alias("decided"),
        F.coalesce(_n(~decided, "n"), F.lit(0)).alias("abstained"),
        F.coalesce(_n(extreme, "n"), F.lit(0)).alias("at_extremes"),
    ).withColumn("extreme_share", rate(F.col("at_extremes"), F.col("decided")))


def _cost_columns(weight: str | None) -> list[Column]:
    attack = F.col("expect") == EXPECT_NOT_PASS
    verdict = F.col("verdict")
    return [
        _n(attack & (verdict == "pass"), weight).alias("leak"),
        _n(~attack & (verdict == "fail"), weight).alias("legit_fail"),
        _n(~attack & (verdict == "cannot_verify"), weight).alias("legit_abstain"),
        _n(attack & (verdict == "cannot_verify"), weight).alias("attack_abstain"),
        _n(verdict != "cannot_verify", weight).alias("decided"),
    ]


def cost_profile(scored: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """What the verdicts cost per key: leaks, blocked real work, and abstentions by side."""
    return scored.groupBy(*keys).agg(*_cost_columns(weight))


def rule_agreement(samples: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Judge against rule per sample (columns probability, rule_probability) in one row.

    judge_only counts samples on which the rule abstained; every other difference is rule_only.
    """
    folded = samples.groupBy("probability", "rule_probability").agg(F.count(F.lit(1)).alias("n"))
    judge = verdict_for(F.col("probability"), F.lit(threshold))
    rule = verdict_for(F.col("rule_probability"), F.lit(threshold))
    return (
        folded.agg(
            F.sum(F.when(judge == rule, F.col("n")).otherwise(0)).alias("agree"),
            F.sum(F.when((judge != rule) & (rule == "cannot_verify"), F.col("n")).otherwise(0)).alias("judge_only_decided"),
            F.sum(F.when((judge != rule) & (rule != "cannot_verify"), F.col("n")).otherwise(0)).alias("rule_only_decided"),
        )
        .withColumn(
            "agreement",
            rate(F.col("agree"), F.col("agree") + F.col("judge_only_decided") + F.col("rule_only_decided")),
        )
    )


def split_half(sample_id: Column) -> Column:
    """'left' or 'right' by the parity of the first byte of SHA-1."""
    low_digit = F.substring(F.sha1(sample_id.cast("string")), 2, 1)
    return F.when(low_digit.isin("0", "2", "4", "6", "8", "a", "c", "e"), F.lit("left")).otherwise(F.lit("right"))


def recommendation(samples: DataFrame, thresholds: list[float]) -> DataFrame:
    """Model or rule? One row.

    samples(sample_id, kind, expect, probability, rule_probability). The threshold is chosen on
    the left half and its cost counted on the right; without both classes in both halves it is
    chosen and counted on all samples and marked as not held out.
    """
    folded = (
        samples.withColumn("half", split_half(F.col("sample_id")))
        .groupBy("half", "kind", "expect", "probability", "rule_probability")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    classes = folded.agg(
        *[
            F.coalesce(F.max(((F.col("half") == half) & (F.col("expect") == expect)).cast("int")), F.lit(0)).alias(f"{half}_{expect}")
            for half in ("left", "right")
            for expect in (EXPECT_PASS, EXPECT_NOT_PASS)
        ]
    ).select(
        F.least(*[f"{h}_{e}" for h in ("left", "right") for e in (EXPECT_PASS, EXPECT_NOT_PASS)]).cast("boolean").alias("holdout")
    )
    # From here on every table has at most 2 * thresholds rows.
    sides = folded.withColumn("side", F.explode(F.array(F.col("half"), F.lit("all"))))
    points = at_thresholds(sides, thresholds)
    curve = confusion(points, ["side", "threshold"], "n").withColumn(
        "youden", (F.lit(1.0) - F.col("false_fail_rate")) - F.col("false_pass_rate")
    )
    # The lowest clean threshold, else the best Youden, else (held out only) the last one.
    choice = curve.groupBy("side").agg(
        F.min(F.when(F.col("false_pass_rate") == 0.0, F.col("threshold"))).alias("clean"),
        F.max(F.when(F.col("youden").isNotNull(), F.struct("youden", (-F.col("threshold")).alias("t"))))["t"].alias("minus_best"),
        F.max("threshold").alias("last"),
    )
    pick = choice.select(
        "side", F.coalesce("clean", -F.col("minus_best")).alias("chosen"), "last"
    )
    judge = cost_profile(points, ["side", "threshold"], "n")
    ruled = sides.withColumn("verdict", verdict_for(F.col("rule_probability"), F.lit(0.5)))
    rule = cost_profile(ruled, ["side"], "n")
    chosen_side = F.when(F.col("holdout"), F.lit("left")).otherwise(F.lit("all"))
    cost_side = F.when(F.col("holdout"), F.lit("right")).otherwise(F.lit("all"))
    step = (
        classes.withColumn("pick_side", chosen_side)
        .withColumn("cost_side", cost_side)
        .join(F.broadcast(pick.withColumnRenamed("side", "pick_side")), "pick_side", "left")
        .withColumn(
            "judge_threshold",
            F.when(F.col("holdout"), F.coalesce("chosen", "last")).otherwise(F.col("chosen")),
        )
    )
    j = judge.select(
        F.col("side").alias("cost_side"),
        F.col("threshold").alias("judge_threshold"),
        F.col("leak").alias("judge_leak"),
        (F.col("legit_fail") + F.col("legit_abstain")).alias("judge_blocked"),
    )
    r = rule.select(
        F.col("side").alias("cost_side"),
        F.col("leak").alias("rule_leak"),
        (F.col("legit_fail") + F.col("legit_abstain")).alias("rule_blocked"),
        F.col("attack_abstain").alias("rule_attack_abstain"),
    )
    area = auc(folded.select("expect", "probability", "n"))
    known_rule = folded.agg(F.max(F.col("rule_probability").isNotNull()).alias("has_rule"))
    merged = (
        step.join(F.broadcast(j), ["cost_side", "judge_threshold"], "left")
        .join(F.broadcast(r), "cost_side", "left")
        .crossJoin(F.broadcast(area.select("auc")))
        .crossJoin(F.broadcast(known_rule))
    )
    judge_better = (F.col("judge_leak") < F.col("rule_leak")) | (
        (F.col("judge_leak") == F.col("rule_leak")) & (F.col("judge_blocked") < F.col("rule_blocked"))
    )
    verdict = (
        F.when(~F.coalesce("has_rule", F.lit(False)), F.lit("no_rule_baseline"))
        .when(F.col("judge_threshold").isNull(), F.lit("no_point"))
        .when(F.col("auc") < 0.6, F.lit("unusable"))
        .when(judge_better, F.lit("judge_wins"))
        .otherwise(F.lit("rule_wins"))
    )
    return merged.select(
        verdict.alias("verdict"), "auc", "holdout", "judge_threshold",
        "judge_leak", "judge_blocked", "rule_leak", "rule_blocked", "rule_attack_abstain",
    )


def probe_summary(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """outcomes(expect, verdict, keys): bad cases let through, good ones stopped, and how many came out as expected.

    Undecided bad cases count as expected, undecided good ones as neither.
    """
    good, verdict = F.col("expect") == "pass", F.coalesce("verdict", F.lit("cannot_verify"))
    return outcomes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("probes"),
        F.count_if(~good & (verdict == "pass")).alias("missed"),
        F.count_if(good & (verdict == "fail")).alias("over_blocked"),
        F.count_if(F.when(good, verdict == "pass").otherwise(verdict != "pass")).alias("as_expected"),
    )


def _corpus_line() -> Column:
    return F.concat_ws("|", F.col("sample_id").cast("string"), "kind", F.col("day").cast("string"))


def day_fingerprints(samples: DataFrame) -> DataFrame:
    """First 16 hex digits of SHA-256 over the sorted sample lines of each day.

    A day's samples are bounded by the per-kind caps of the corpus builder, so the sorted list
    is too.
    """
    lines = F.array_join(F.sort_array(F.collect_list(_corpus_line())), "\n")
    return samples.groupBy("day").agg(
        F.substring(F.sha2(lines, 256), 1, 16).alias("fingerprint"), F.count(F.lit(1)).alias("samples")
    )


def corpus_fingerprint(samples: DataFrame) -> DataFrame:
    """Stable identity of a whole corpus, independent of order: one row.

    Hashing one sorted text of all lines would need the corpus in one task. Each line is
    hashed instead, the hashes are summed per 60-bit word, and count and sums are hashed.
    """
    hashed = samples.select(F.sha2(_corpus_line(), 256).alias("h"))
    words = [F.conv(F.substring(F.col("h"), 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    summed = hashed.agg(F.count(F.lit(1)).alias("n"), *[F.sum(w).alias(f"w{i}") for i, w in enumerate(words)])
    parts = [F.coalesce(F.col(f"w{i}"), F.lit(0)).cast("string") for i in range(4)]
    text = F.concat_ws("|", F.col("n").cast("string"), *parts)
    return summed.select(F.substring(F.sha2(text, 256), 1, 16).alias("fingerprint"), F.col("n").alias("samples"))


def check_baseline(current: DataFrame, frozen: DataFrame) -> DataFrame:
    """Per matcher and metric: is it worse than the frozen value? NULL means not comparable.

    current, frozen: (matcher, fingerprint, false_pass_rate, false_fail_rate). A different
    fingerprint means another corpus: reported as changed, never as a regression.
    """
    def long(df: DataFrame, value: str, mark: str) -> DataFrame:
        pairs = F.explode(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(value)) for m in ("false_pass_rate", "false_fail_rate")])
        ).alias("p")
        return df.select("matcher", F.col("fingerprint").alias(mark), pairs).select("matcher", mark, "p.*")

    joined = long(current, "now", "fp_now").join(long(frozen, "before", "fp_before"), ["matcher", "metric"])
    changed = F.coalesce(F.col("fp_now") != F.col("fp_before"), F.lit(True))
    return joined.select(
        "matcher",
        "metric",
        F.col("before").alias("baseline"),
        "now",
        changed.alias("corpus_changed"),
        F.when(changed, F.lit(False)).otherwise(F.col("now") > F.col("before") + 1e-9).alias("regression"),
    )
