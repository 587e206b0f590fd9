"""Queries: corpora, matcher scores, sweeps, selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions.decisions import rule_probability
from attesta.functions.vocabulary import EXPECT_NOT_PASS
from attesta.operators import corpus, provenance, scoring, selection
from attesta.plans import inputs, sql
from attesta.plans.registry import query
from attesta.session import materialise, table

CAP = 25
THRESHOLDS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]

_URL = sql.canonical("url")
CORPUS_SQL = f"""{sql.CAPTURED}, {sql.KNOWN},
cited AS (SELECT day, page_id AS position, url, canonical FROM captured),
legit AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY position) - 1 AS i FROM cited c
  WHERE EXISTS (SELECT 1 FROM known k WHERE k.day = c.day AND k.canonical = c.canonical) QUALIFY i < {CAP}),
bases AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY canonical) - 1 AS i FROM known WHERE length(canonical) > 20 QUALIFY i < {CAP}),
attacks AS (
  SELECT day, i, 'ext' AS stem, 'prefix_extension' AS kind, 'https://' || canonical || '/this-page-never-existed' AS url FROM bases
  UNION ALL SELECT day, i, 'fab', 'fabricated_suffix', 'https://' || canonical || '-v99-fake' FROM bases),
days AS (SELECT DISTINCT day FROM known),
pool AS (
  SELECT d.day, c.canonical, min(c.position) AS position, arg_min(c.url, c.position) AS url
  FROM days d JOIN cited c ON c.day <> d.day
  WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.day = d.day AND split_part(k.canonical, '?', 1) = split_part(c.canonical, '?', 1))
  GROUP BY d.day, c.canonical),
stale AS (SELECT day, url, row_number() OVER (PARTITION BY day ORDER BY position) - 1 AS i FROM pool QUALIFY i < {CAP}),
uncited AS (SELECT day, 'https://' || canonical AS url, row_number() OVER (PARTITION BY day ORDER BY canonical) - 1 AS i FROM known k
  WHERE NOT EXISTS (SELECT 1 FROM cited c WHERE c.day = k.day AND c.canonical = k.canonical) QUALIFY i < {CAP}),
parts AS (
  SELECT day, i, 'legit' AS stem, 'legit' AS kind, url, 'pass' AS expect FROM legit
  UNION ALL SELECT day, i, 'drift', 'legit_drift', {sql.rotated('url', 'i')}, 'pass' FROM legit
  UNION ALL SELECT day, i, stem, kind, url, 'not_pass' FROM attacks a
    WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.day = a.day AND k.canonical = {sql.canonical('a.url')})
  UNION ALL SELECT day, i, 'unrel', 'unrelated', 'https://example.invalid/' || day::VARCHAR || '/invented-' || i::VARCHAR, 'not_pass'
    FROM days, (SELECT unnest(range(5)) AS i)
  UNION ALL SELECT day, i, 'stale', 'stale_evidence', url, 'not_pass' FROM stale
  UNION ALL SELECT day, i, 'uncited', 'plausible_uncited', url, 'pass' FROM uncited),
samples AS (SELECT day::VARCHAR || '-' || stem || '-' || lpad(i::VARCHAR, 3, '0') AS sample_id, kind, url, day, expect FROM parts)"""

SCORED_SQL = f"""{CORPUS_SQL}, {sql.typed('samples', 'sample_id, kind, expect')}, {sql.legacy_verdicts('samples', 'sample_id, kind, expect')},
scored AS (SELECT 'typed' AS matcher, sample_id, kind, expect, decision AS verdict FROM typed
  UNION ALL SELECT 'legacy', sample_id, kind, expect, decision FROM old)"""


def samples(spark, root):
    """The corpus, written once: several matchers read it, each more than once."""
    return materialise(corpus.build_corpus(inputs.article_citations(spark, root), inputs.known(spark, root), CAP), "corpus")


def scored(spark, root):
    """Every sample judged by both matchers: (matcher, sample_id, kind, expect, day, verdict)."""
    labelled = samples(spark, root)
    known = inputs.known(spark, root)
    keep = ["sample_id", "kind", "expect", "day", F.col("decision").alias("verdict")]
    typed = provenance.classify_citations(labelled, known).select(F.lit("typed").alias("matcher"), *keep)
    legacy = provenance.legacy_citations(labelled, known).select(F.lit("legacy").alias("matcher"), *keep)
    return typed.unionByName(legacy)


@query("corpus_samples", f"WITH {CORPUS_SQL} SELECT sample_id, kind, url, day, expect FROM samples")
def corpus_samples(spark, root):
    return samples(spark, root)


@query("corpus_sizes", f"WITH {CORPUS_SQL} SELECT kind, expect, count(*)::BIGINT AS samples FROM samples GROUP BY kind, expect")
def corpus_sizes(spark, root):
    return samples(spark, root).groupBy("kind", "expect").agg(F.count(F.lit(1)).alias("samples"))


@query(
    "corpus_subsample",
    f"""WITH {CORPUS_SQL} SELECT sample_id, kind, day FROM samples
QUALIFY row_number() OVER (PARTITION BY kind ORDER BY day, sample_id) <= 8""",
)
def corpus_subsample(spark, root):
    """The same few samples of each kind for every matcher, so that a paid judge stays comparable."""
    return corpus.subsample(samples(spark, root), 8).select("sample_id", "kind", "day")


@query(
    "corpus_day_fingerprints",
    f"""WITH {CORPUS_SQL} SELECT day, substr(sha256(string_agg(l, chr(10) ORDER BY l)), 1, 16) AS fingerprint, count(*)::BIGINT AS samples
FROM (SELECT day, sample_id || '|' || kind || '|' || day::VARCHAR AS l FROM samples) GROUP BY day""",
)
def corpus_day_fingerprints(spark, root):
    return scoring.day_fingerprints(samples(spark, root))


_WORDS = " || '|' || ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT)::VARCHAR" for i in range(4))


@query(
    "corpus_fingerprint",
    f"""WITH {CORPUS_SQL} SELECT substr(sha256(count(*)::VARCHAR || '|' || {_WORDS}), 1, 16) AS fingerprint, count(*)::BIGINT AS samples
FROM (SELECT sha256(sample_id || '|' || kind || '|' || day::VARCHAR) AS h FROM samples)""",
)
def corpus_fingerprint(spark, root):
    return scoring.corpus_fingerprint(samples(spark, root))


@query("score_matchers", f"WITH {SCORED_SQL} SELECT matcher, {sql.rates()} FROM scored GROUP BY matcher")
def score_matchers(spark, root):
    """Confusion matrix of the old and the typed matcher on the same corpus."""
    return scoring.confusion(scored(spark, root), ["matcher"])


@query(
    "per_kind_verdicts",
    f"""WITH {SCORED_SQL} SELECT matcher, kind, count(*) FILTER (verdict = 'pass')::BIGINT AS n_pass, count(*) FILTER (verdict = 'fail')::BIGINT AS n_fail,
count(*) FILTER (verdict = 'cannot_verify')::BIGINT AS n_cannot_verify, count(*) FILTER (verdict = 'abstain')::BIGINT AS n_abstain
FROM scored GROUP BY matcher, kind""",
)
def per_kind_verdicts(spark, root):
    return scoring.per_kind(scored(spark, root), ["matcher"])


@query(
    "probe_summary",
    f"""WITH {SCORED_SQL} SELECT matcher, kind, count(*)::BIGINT AS probes, count(*) FILTER (expect <> 'pass' AND verdict = 'pass')::BIGINT AS missed,
count(*) FILTER (expect = 'pass' AND verdict = 'fail')::BIGINT AS over_blocked, count(*) FILTER ((expect = 'pass') = (verdict = 'pass'))::BIGINT AS as_expected
FROM scored GROUP BY matcher, kind""",
)
def probe_summary(spark, root):
    """What either matcher lets through or stops wrongly, by kind of case."""
    return scoring.probe_summary(scored(spark, root), ["matcher", "kind"])


@query(
    "sample_flags",
    f"""WITH {SCORED_SQL} SELECT matcher, count(*) FILTER ((verdict = 'pass') = (expect = 'pass'))::BIGINT AS safe,
count(*) FILTER (CASE WHEN expect = 'pass' THEN verdict = 'pass' ELSE verdict = 'fail' END)::BIGINT AS strict FROM scored GROUP BY matcher""",
)
def sample_flags(spark, root):
    flagged = scoring.sample_flags(scored(spark, root))
    return flagged.groupBy("matcher").agg(F.count_if("safe").alias("safe"), F.count_if("strict").alias("strict"))


_HALF = "CASE WHEN ('0x' || substr(sha1(sample_id), 1, 2))::INTEGER % 2 = 0 THEN 'left' ELSE 'right' END"


@query(
    "baseline_check",
    f"""WITH {SCORED_SQL}, now AS (SELECT matcher, {sql.rates()} FROM scored GROUP BY matcher),
frozen AS (SELECT matcher, {sql.rates()} FROM scored WHERE {_HALF} = 'left' GROUP BY matcher),
long AS (
  SELECT n.matcher, 'false_pass_rate' AS metric, f.false_pass_rate AS baseline, n.false_pass_rate AS now FROM now n JOIN frozen f USING (matcher)
  UNION ALL SELECT n.matcher, 'false_fail_rate', f.false_fail_rate, n.false_fail_rate FROM now n JOIN frozen f USING (matcher))
SELECT matcher, metric, baseline, now, matcher <> 'typed' AS corpus_changed, matcher = 'typed' AND now > baseline + 1e-9 AS regression FROM long""",
)
def baseline_check(spark, root):
    """Rates on the whole corpus against rates frozen on its left half; one baseline is of another corpus."""
    judged = materialise(scored(spark, root).select("sample_id", "matcher", "expect", "verdict"), "scored")
    now = scoring.confusion(judged, ["matcher"]).withColumn("fingerprint", F.lit("this"))
    left = judged.filter(scoring.split_half(F.col("sample_id")) == "left")
    own = F.when(F.col("matcher") == "typed", F.lit("this")).otherwise(F.lit("other"))
    frozen = scoring.confusion(left, ["matcher"]).withColumn("fingerprint", own)
    return scoring.check_baseline(now, frozen)


@query(
    "rule_probabilities",
    f"""WITH {SCORED_SQL} SELECT sample_id, CASE verdict WHEN 'pass' THEN 1.0 WHEN 'fail' THEN 0.0 END::DOUBLE AS rule_probability FROM scored WHERE matcher = 'typed'""",
)
def rule_probabilities(spark, root):
    """The typed matcher on the judge's scale; what it cannot decide stays NULL."""
    judged = provenance.classify_citations(samples(spark, root), inputs.known(spark, root))
    return judged.select("sample_id", rule_probability(F.col("decision")).alias("rule_probability"))


# -- sweeps --------------------------------------------------------------------------------------


def _sweep_sql(band: float) -> str:
    inside = f"WHEN abs(probability - t.threshold) < {band / 2} THEN 'cannot_verify'" if band else ""
    return f"""{sql.JUDGED}, thresholds AS (SELECT unnest({THRESHOLDS})::DOUBLE AS threshold),
points AS (SELECT t.threshold, j.*, CASE WHEN probability IS NULL THEN 'cannot_verify' {inside}
  WHEN probability >= t.threshold THEN 'pass' ELSE 'fail' END AS verdict FROM judged j, thresholds t),
curve AS (SELECT threshold, {sql.rates()} FROM points GROUP BY threshold)"""


def _counts(spark, root):
    return scoring.probability_counts(inputs.judged_samples(spark, root))


@query("sweep_curve", f"WITH {_sweep_sql(0)} SELECT * FROM curve")
def sweep_curve(spark, root):
    return scoring.sweep(_counts(spark, root), THRESHOLDS)


@query("sweep_band", f"WITH {_sweep_sql(0.2)} SELECT * FROM curve")
def sweep_band(spark, root):
    return scoring.sweep(_counts(spark, root), THRESHOLDS, band=0.2)


@query(
    "sweep_per_kind",
    f"""WITH {_sweep_sql(0)} SELECT threshold, kind, count(*) FILTER (verdict = 'pass')::BIGINT AS n_pass, count(*) FILTER (verdict = 'fail')::BIGINT AS n_fail,
count(*) FILTER (verdict = 'cannot_verify')::BIGINT AS n_cannot_verify, 0::BIGINT AS n_abstain FROM points GROUP BY threshold, kind""",
)
def sweep_per_kind(spark, root):
    return scoring.per_kind(scoring.at_thresholds(_counts(spark, root), THRESHOLDS), ["threshold"], "n")


@query(
    "sweep_auc",
    f"""WITH {sql.JUDGED}, p AS (SELECT probability FROM judged WHERE expect = 'pass' AND probability IS NOT NULL),
n AS (SELECT probability FROM judged WHERE expect = 'not_pass' AND probability IS NOT NULL)
SELECT (SELECT round_even(sum(CASE WHEN p.probability > n.probability THEN 1.0 WHEN p.probability = n.probability THEN 0.5 ELSE 0 END) / count(*)::DOUBLE, 4) FROM p, n) AS auc,
  (SELECT count(*) FROM p)::BIGINT AS legit_decided, (SELECT count(*) FROM n)::BIGINT AS attack_decided""",
)
def sweep_auc(spark, root):
    return scoring.auc(_counts(spark, root))


@query(
    "sweep_degeneracy",
    f"""WITH {sql.JUDGED} SELECT count(probability)::BIGINT AS decided, count(*) FILTER (probability IS NULL)::BIGINT AS abstained,
count(*) FILTER (probability IN (0, 1))::BIGINT AS at_extremes, round_even(count(*) FILTER (probability IN (0, 1)) / count(probability)::DOUBLE, 4) AS extreme_share FROM judged""",
)
def sweep_degeneracy(spark, root):
    return scoring.degeneracy(_counts(spark, root))


_COST = """count(*) FILTER (expect = 'not_pass' AND verdict = 'pass')::BIGINT AS leak,
count(*) FILTER (expect = 'pass' AND verdict = 'fail')::BIGINT AS legit_fail, count(*) FILTER (expect = 'pass' AND verdict = 'cannot_verify')::BIGINT AS legit_abstain,
count(*) FILTER (expect = 'not_pass' AND verdict = 'cannot_verify')::BIGINT AS attack_abstain, count(*) FILTER (verdict <> 'cannot_verify')::BIGINT AS decided"""


@query("sweep_cost", f"WITH {_sweep_sql(0)} SELECT threshold, {_COST} FROM points GROUP BY threshold")
def sweep_cost(spark, root):
    return scoring.cost_profile(scoring.at_thresholds(_counts(spark, root), THRESHOLDS), ["threshold"], "n")


@query(
    "sweep_agreement",
    f"""WITH {sql.JUDGED}, v AS (SELECT CASE WHEN probability IS NULL THEN 'cannot_verify' WHEN probability >= 0.5 THEN 'pass' ELSE 'fail' END AS j,
  CASE WHEN rule_probability IS NULL THEN 'cannot_verify' WHEN rule_probability >= 0.5 THEN 'pass' ELSE 'fail' END AS r FROM judged)
SELECT count(*) FILTER (j = r)::BIGINT AS agree, count(*) FILTER (j <> r AND r = 'cannot_verify')::BIGINT AS judge_only_decided,
  count(*) FILTER (j <> r AND r <> 'cannot_verify')::BIGINT AS rule_only_decided, round_even(count(*) FILTER (j = r) / count(*)::DOUBLE, 4) AS agreement FROM v""",
)
def sweep_agreement(spark, root):
    return scoring.rule_agreement(inputs.judged_samples(spark, root))


@query(
    "sweep_operating_point",
    f"WITH {_sweep_sql(0)} SELECT threshold, false_pass_rate, false_fail_rate FROM curve WHERE false_pass_rate = 0 ORDER BY threshold LIMIT 1",
)
def sweep_operating_point(spark, root):
    curve = scoring.sweep(_counts(spark, root), THRESHOLDS)
    return scoring.operating_point(curve).select("threshold", "false_pass_rate", "false_fail_rate")


@query(
    "sweep_best_point",
    f"""WITH {_sweep_sql(0)} SELECT threshold, false_pass_rate, false_fail_rate FROM curve
WHERE false_pass_rate IS NOT NULL AND false_fail_rate IS NOT NULL ORDER BY (1 - false_fail_rate) - false_pass_rate DESC, threshold LIMIT 1""",
)
def sweep_best_point(spark, root):
    curve = scoring.sweep(_counts(spark, root), THRESHOLDS)
    return scoring.best_point(curve).select("threshold", "false_pass_rate", "false_fail_rate")


_SIDE = _HALF.replace("sample_id", "sample_id::VARCHAR")


@query("sweep_split", f"WITH {sql.JUDGED} SELECT {_SIDE} AS half, expect, count(*)::BIGINT AS samples FROM judged GROUP BY 1, 2")
def sweep_split(spark, root):
    halves = inputs.judged_samples(spark, root).select(scoring.split_half(F.col("sample_id")).alias("half"), "expect")
    return halves.groupBy("half", "expect").agg(F.count(F.lit(1)).alias("samples"))


@query(
    "sweep_recommendation",
    f"""WITH {_sweep_sql(0)}, sided AS (SELECT *, {_SIDE} AS half FROM points),
lcurve AS (SELECT threshold, {sql.rates()} FROM sided WHERE half = 'left' GROUP BY threshold),
pick AS (SELECT coalesce((SELECT min(threshold) FROM lcurve WHERE false_pass_rate = 0),
  (SELECT threshold FROM lcurve ORDER BY (1 - false_fail_rate) - false_pass_rate DESC, threshold LIMIT 1)) AS t),
jc AS (SELECT {_COST} FROM sided, pick WHERE half = 'right' AND threshold = t),
rv AS (SELECT expect, CASE WHEN rule_probability IS NULL THEN 'cannot_verify' WHEN rule_probability >= 0.5 THEN 'pass' ELSE 'fail' END AS verdict FROM judged WHERE {_SIDE} = 'right'),
rc AS (SELECT {_COST} FROM rv),
a AS (SELECT round_even(sum(CASE WHEN p.probability > n.probability THEN 1.0 WHEN p.probability = n.probability THEN 0.5 ELSE 0 END) / count(*)::DOUBLE, 4) AS auc
  FROM judged p, judged n WHERE p.expect = 'pass' AND n.expect = 'not_pass' AND p.probability IS NOT NULL AND n.probability IS NOT NULL)
SELECT CASE WHEN auc < 0.6 THEN 'unusable' WHEN jc.leak < rc.leak OR (jc.leak = rc.leak AND jc.legit_fail + jc.legit_abstain < rc.legit_fail + rc.legit_abstain)
  THEN 'judge_wins' ELSE 'rule_wins' END AS verdict, auc, true AS holdout, t AS judge_threshold, jc.leak AS judge_leak,
  (jc.legit_fail + jc.legit_abstain)::BIGINT AS judge_blocked, rc.leak AS rule_leak, (rc.legit_fail + rc.legit_abstain)::BIGINT AS rule_blocked,
  rc.attack_abstain AS rule_attack_abstain FROM pick, jc, rc, a""",
)
def sweep_recommendation(spark, root):
    """Model or rule: threshold chosen on one half, cost counted on the other."""
    return scoring.recommendation(inputs.judged_samples(spark, root), THRESHOLDS)


# -- selection -----------------------------------------------------------------------------------

_SHEET = """sheet AS (SELECT d.lang AS day, d.doc_id, CASE WHEN d.n_chars >= 1000 THEN 'selected' ELSE 'unselected' END AS bucket,
  CASE WHEN l.doc_id IS NULL THEN '' WHEN l.quality = 1 AND l.toxic = 1 THEN 'either' WHEN l.quality = 1 THEN 'select' ELSE 'reject' END AS gold
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def _sheet(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, root, "labels")
    gold = (
        F.when(F.col("quality").isNull(), "").when((F.col("quality") == 1) & (F.col("toxic") == 1), "either")
        .when(F.col("quality") == 1, "select").otherwise("reject")
    )
    return docs.join(labels, "doc_id", "left").select(
        F.col("lang").alias("day"), "doc_id",
        F.when(F.col("n_chars") >= 1000, "selected").otherwise("unselected").alias("bucket"), gold.alias("gold"),
    )


@query(
    "selection_score",
    f"""WITH {_SHEET}, c AS (SELECT day, count(*)::BIGINT AS sheet_rows, count(*) FILTER (gold IN ('select', 'reject'))::BIGINT AS labelled,
count(*) FILTER (gold = 'either')::BIGINT AS either, count(*) FILTER (gold = 'select' AND bucket = 'selected')::BIGINT AS tp,
count(*) FILTER (gold = 'reject' AND bucket = 'selected')::BIGINT AS fp, count(*) FILTER (gold = 'select' AND bucket <> 'selected')::BIGINT AS fn,
count(*) FILTER (gold = 'reject' AND bucket <> 'selected')::BIGINT AS tn FROM sheet GROUP BY GROUPING SETS ((day), ()))
SELECT coalesce(day, 'total') AS day, sheet_rows, labelled, either, tp, fp, fn, tn, round_even(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision,
round_even(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round_even((tp + tn) / nullif(tp + fp + fn + tn, 0)::DOUBLE, 6) AS accuracy FROM c""",
)
def selection_score(spark, root):
    """Length as a predictor of human quality labels, per language and in total."""
    scores = selection.score_sheet(_sheet(spark, root))
    return scores.select(
        F.when(F.col("is_total") == 1, F.lit("total")).otherwise(F.col("day")).alias("day"),
        "sheet_rows", "labelled", "either", "tp", "fp", "fn", "tn", "precision", "recall", "accuracy",
    )


@query(
    "selection_sheet",
    f"""WITH {_SHEET}, h AS (SELECT *, sha256('selection|' || doc_id::VARCHAR) AS h FROM sheet),
l AS (SELECT *, row_number() OVER (ORDER BY h, doc_id) AS n FROM h WHERE bucket = 'selected' QUALIFY n <= 50),
r AS (SELECT *, row_number() OVER (ORDER BY h, doc_id) AS n FROM h WHERE bucket <> 'selected' QUALIFY n <= 100 - (SELECT count(*) FROM l)),
b AS (SELECT *, 0 AS side FROM l UNION ALL SELECT *, 1 FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY n, side) AS case_no FROM b)
SELECT 'sel-' || day || '-' || lpad(case_no::VARCHAR, 3, '0') AS case_id, doc_id, bucket FROM o""",
)
def selection_sheet(spark, root):
    sheet = _sheet(spark, root).withColumnRenamed("doc_id", "key").drop("bucket")
    chosen = table(spark, root, "documents").select(F.col("doc_id").alias("key"), "n_chars")
    both = sheet.join(chosen, "key")
    built = selection.build_sheet(both.filter("n_chars >= 1000"), both.filter("n_chars < 1000"), 100)
    return built.select("case_id", F.col("key").alias("doc_id"), "bucket")
