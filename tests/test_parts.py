"""Smaller parts that no query reaches: sinks, promoted runs, post filters, frontier and caveats."""

import csv

import pytest
from pyspark.sql import functions as F

from attesta.functions import parsing
from attesta.operators import compose, coverage, experiment, scoring
from attesta.sources import memory, sheets


def test_redact_hides_whatever_is_set(spark):
    rows = spark.createDataFrame([("k1",), ("",), (None,), ("x" * 5000,)], "v string")
    assert [r.r for r in rows.select(parsing.redact(F.col("v")).alias("r")).collect()] == ["***", "(unset)", "(unset)", "***"]


def test_bilingual_pair(spark):
    cases = {'"both"': ("both", "both"), '{"zh":"z"}': ("z", ""), '{"zh":"z","en":"e"}': ("z", "e"), "5": ("", ""), "null": ("", ""), "[1]": ("", "")}
    rows = spark.createDataFrame([(k,) for k in cases], "j string")
    got = {r.j: (r.p.zh, r.p.en) for r in rows.select("j", compose.bilingual_pair(F.parse_json("j")).alias("p")).collect()}
    assert got == cases


def test_promoted_runs_become_notes_that_name_their_run(spark):
    runs = spark.createDataFrame([("r1", "daily", "2026-01-02", "success"), ("r2", "daily", "2026-01-03", "failed")], "run_id string, task string, target_date string, status string")
    promoted = spark.createDataFrame([("r1", "A good day"), ("r9", "unknown")], "run_id string, title string")
    note = memory.promote_runs(runs, promoted).collect()
    assert [(n.path, n.kind, n.date, n.source, n.tags) for n in note] == [("notes/2026-01-02-A-good-day.md", "notes", "2026-01-02", "run:r1", ["daily", "promoted"])]
    assert note[0].body == "# A good day\n\n- task: daily (2026-01-02)\n- status: success\n"


def test_posts_are_filtered_after_ranking(spark):
    long = "a post that is long enough to say something of its own"
    rows = [
        ("2026-01-01", "tweets_ai", 1, long, "u1", "2026-01-01", 9.0), ("2026-01-01", "tweets_ai", 2, long, "u2", "2025-12-30", 8.0),
        ("2026-01-01", "tweets_ai", 3, "too short", "u3", "2026-01-01", 7.0), ("2026-01-01", "tweets_ai", 4, "https://x.org/" + "y" * 60, "u4", "", 6.0),
        ("2026-01-01", "tweets_ai", 5, long, "  ", None, 5.0), ("2026-01-01", "tweets_ai", 6, long, "u6", None, 4.0), ("2026-01-01", "tweets_ai", 7, long, "u7", None, 3.0),
        ("2026-01-01", "hn", 1, "short", "h1", None, None), ("2026-01-01", "hn", 2, "short", "", None, 1.0), ("2026-01-01", "hn", 3, None, None, None, 2.0),
    ]
    frame = spark.createDataFrame([(d, b, "s", p, "t", u, x, dt, n, None) for d, b, p, x, u, dt, n in rows],
                                  "day string, bucket string, source string, position int, title string, url string, text string, date string, signal_number double, signal_text string")
    got = {(r.bucket, r.url): (r.rank_in_source, r.off_window) for r in coverage.ranked_pool(frame, 6).collect()}
    # Empty addresses, short and link-only posts leave gaps; a post of another day is kept and marked; the seventh was never ranked.
    assert got == {("tweets_ai", "u1"): (1, False), ("tweets_ai", "u2"): (2, True), ("tweets_ai", "u6"): (6, False), ("hn", "h1"): (3, False)}


def test_frontier_and_caveats(spark):
    points = spark.createDataFrame([("a", 3.0, 0.9, "llm", "tokens"), ("b", 1.0, 0.5, "replay", "cost_usd"), ("c", 2.0, 0.4, "llm", "cost_usd"), ("d", 1.0, 0.5, "llm", "cost_usd")],
                                   "arm string, cost double, score double, compose_mode string, axis string")
    marked = experiment.pareto(points)
    assert [r.arm for r in experiment.frontier(marked).collect()] == ["b", "d", "a"]
    runs = spark.createDataFrame([(1.0, None), (None, False), (None, None)], "verifiable_ratio double, validators_ok boolean")
    row = experiment.caveats(runs, marked).first()
    assert (row.unscored_runs, row.replay_on_frontier, row.tokens_axis) == (1, 1, 1)


def test_probe_summary(spark):
    rows = [("g", "pass", "pass"), ("g", "pass", "fail"), ("g", "pass", "cannot_verify"), ("g", "not_pass", "pass"), ("g", "not_pass", "fail"), ("g", "not_pass", None)]
    got = scoring.probe_summary(spark.createDataFrame(rows, "gate string, expect string, verdict string"), ["gate"]).first()
    assert (got.probes, got.missed, got.over_blocked, got.as_expected) == (6, 1, 1, 3)


def test_report_is_read_back_and_bound_to_its_corpus(spark, tmp_path):
    rows = [("a", "k", "pass", 0.9, 1.0), ("b", "k", "pass", None, 0.0), ('c "x"', "m", "not_pass", 0.25, None)]
    verdicts = spark.createDataFrame(rows, "sample_id string, kind string, expect string, probability double, rule_probability double")
    path = str(tmp_path / "report")
    sheets.save_report(verdicts, "f1", path)
    back = sheets.load_report(spark, path, "f1")
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    points = [[tuple(r) for r in scoring.sweep(scoring.probability_counts(v), [0.1, 0.5, 0.9]).collect()] for v in (verdicts, back)]
    assert sorted(points[0], key=str) == sorted(points[1], key=str)
    with pytest.raises(Exception, match="not a report of this corpus"):
        sheets.load_report(spark, path, "f2").collect()
    (tmp_path / "report" / "part-x.txt").write_text("{broken\n")
    with pytest.raises(Exception, match="not a report of this corpus"):
        sheets.load_report(spark, path, "f1").collect()


def test_report_writers(spark, tmp_path):
    report = spark.createDataFrame([("m", 0.5, [1, 2], None), ('q"|', None, [], "x\ny")], "matcher string, rate double, runs array<int>, note string")
    sheets.write_report(report, str(tmp_path / "r"))
    assert sorted(map(str, spark.read.schema(report.schema).json(str(tmp_path / "r" / "json")).collect())) == sorted(map(str, report.collect()))
    lines = [row for f in (tmp_path / "r" / "csv").glob("*.csv") for row in csv.reader(f.read_text().splitlines())]
    assert ["matcher", "rate", "note"] in lines and any(row[:2] == ["m", "0.5"] for row in lines)
    assert sheets.markdown(report.select("matcher", "rate")).splitlines() == ["| matcher | rate |", "| --- | --- |", "| m | 0.5 |", '| q"/ | - |']


def test_frozen_baseline_is_read_back_and_compared(spark, tmp_path):
    shape = "matcher string, fingerprint string, samples long, false_pass_rate double, false_fail_rate double"
    now = spark.createDataFrame([("typed", "f1", 10, 0.1, None), ("legacy", "f2", 10, 0.5, 0.0), ("new", "f1", 10, 0.0, 0.0)], shape)
    frozen = spark.createDataFrame([("typed", "f1", 10, 0.05, 0.2), ("legacy", "f1", 9, 0.1, 0.0)], shape)
    sheets.freeze_baseline(frozen, str(tmp_path / "base"))
    held = sheets.load_baseline(spark, str(tmp_path / "base"))
    assert sorted(held.collect()) == sorted(frozen.collect())
    got = {(r.matcher, r.metric): (r.corpus_changed, r.regression) for r in scoring.check_baseline(now, held).collect()}
    assert got == {
        ("typed", "false_pass_rate"): (False, True), ("typed", "false_fail_rate"): (False, None),
        ("legacy", "false_pass_rate"): (True, False), ("legacy", "false_fail_rate"): (True, False),
    }
    with pytest.raises(Exception):
        sheets.load_baseline(spark, str(tmp_path / "none")).collect()
